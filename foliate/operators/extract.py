"""Replies of an extraction model: parse, coerce, validate against field specifications. Pure Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliate.config import FIELDS, META_FIELD, REMOVED_FIELDS, UNKNOWN, Field
from foliate.functions.columns import bind
from foliate.functions.formats import CHECKS, checked
from foliate.functions.text import strip, without_fence


def parse_reply(reply: Column) -> Column:
    """map<string,string> of a JSON object's members, or null if the reply, also without a code fence, is none.

    Strings stay, any other value becomes empty. An array or scalar counts as unparseable (its status is ``failed``).
    """
    as_text = lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise("")
    members = lambda tree: F.transform_values(F.try_variant_get(tree, "$", "map<string,variant>"), as_text)
    parsed = lambda tree: F.when(F.schema_of_variant(tree).startswith("OBJECT"), members(tree))
    return bind(F.coalesce(F.try_parse_json(strip(reply)), F.try_parse_json(without_fence(reply))), parsed)


def without_removed(record: Column, life: Column) -> Column:
    """Drops the removed fields, and the meta member, of life records."""
    gone = [*REMOVED_FIELDS, META_FIELD]
    return F.when(life, F.map_filter(record, lambda k, _: ~k.isin(gone))).otherwise(record)


def field_specs(spark: SparkSession) -> DataFrame:
    rows = [(kind, i, f.name, f.format, f.required) for kind, fields in FIELDS.items() for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "doc_type string, ordinal int, name string, format string, required boolean")


def field_names(doc_type: str) -> list[str]:
    return [f.name for f in FIELDS.get(doc_type, [])]


def validated(record: Column, fields: list[Field], rescue: bool) -> Column:
    """Struct of all fields of a type: unknown keys go, missing ones are empty, formats that fail are empty."""
    out = []
    for f in fields:
        value = F.coalesce(F.element_at(record, f.name), F.lit(""))
        if f.required and rescue:
            value = F.when(value == "", UNKNOWN).otherwise(value)
        out.append(checked(value, f.format).alias(f.name))
    return F.struct(*out)


def missing_fields(record: Column, fields: list[Field]) -> Column:
    """Names of required fields that are absent or empty."""
    needed = [F.when(F.coalesce(F.element_at(record, f.name), F.lit("")) == "", F.lit(f.name)) for f in fields if f.required]
    return F.filter(F.array(*needed), lambda x: x.isNotNull()) if needed else F.array().cast("array<string>")


def validate(rows: DataFrame, doc_type: str, record_col: str = "record") -> DataFrame:
    """Adds the type's fields as columns, ``errors`` (before the rescue) and ``status``."""
    fields = FIELDS.get(doc_type)
    if not fields:
        raise KeyError(f"no fields for document type {doc_type!r}")
    life = doc_type == "life"
    record = without_removed(F.col(record_col), F.lit(life))
    rows = rows.withColumn("__record", record)
    rows = rows.withColumn("errors", F.when(F.col("__record").isNotNull(), missing_fields(F.col("__record"), fields)))
    rows = rows.withColumn("__fields", validated(F.coalesce("__record", F.create_map().cast("map<string,string>")), fields, life))
    status = F.when(F.col("__record").isNull(), "failed").otherwise("success")
    kept = [c for c in rows.columns if c not in ("__record", "__fields")]
    return rows.select(*kept, *[F.when(F.col("__record").isNotNull(), F.col(f"__fields.{f.name}")).alias(f.name) for f in fields], status.alias("status"))


def validate_mixed(rows: DataFrame, type_col: str = "doc_type", record_col: str = "record") -> DataFrame:
    """Rows of any type: adds ``extracted`` (map of the type's fields) and ``status``; a row's own type decides.

    The specifications are one literal map, and each format check occurs once in the plan, whatever the number of fields.
    """
    spec = lambda f: F.struct(F.lit(f.name).alias("name"), F.lit(f.format).alias("format"), F.lit(f.required).alias("required"))
    specs = F.create_map(*[x for kind, fields in FIELDS.items() for x in (F.lit(kind), F.array(*map(spec, fields)))])
    life = F.col(type_col) == "life"

    def value(record: Column, f: Column) -> Column:
        raw = F.coalesce(F.element_at(record, f["name"]), F.lit(""))
        raw = F.when(f["required"] & life & (raw == ""), UNKNOWN).otherwise(raw)

        def check(v: Column) -> Column:
            out = v
            for kind in CHECKS:
                out = F.when(f["format"] == kind, checked(v, kind)).otherwise(out)
            return out

        return bind(raw, check)

    fields = F.element_at(specs, F.col(type_col))
    names = F.transform(fields, lambda f: f["name"])
    made = bind(without_removed(F.col(record_col), life), lambda r: F.when(r.isNotNull() & fields.isNotNull(), F.map_from_arrays(names, F.transform(fields, lambda f: value(r, f)))))
    rows = rows.withColumn("extracted", made)
    return rows.withColumn("status", F.when(F.col("extracted").isNull(), "failed").otherwise("success"))


def prompt_template(doc_type: str) -> str:
    """The prompt of a type, made from its fields; doubled braces stand for single ones, ``{document_text}`` for the text."""
    keys = ",\n".join(f'  "{f.name}": ""' for f in FIELDS[doc_type])
    kinds = {"date": "dates as dd/mm/yyyy", "currency": "amounts as they are written", "phone": "phone numbers with all digits"}
    used = [text for kind, text in kinds.items() if any(f.format == kind for f in FIELDS[doc_type])]
    return (
        f"Extract the fields of this {doc_type} insurance document. Answer with one JSON object of these keys and nothing else;\n"
        f"values are strings, empty where the document does not say. Write {', '.join([*used, 'names in full'])}.\n"
        f"{{{{\n{keys}\n}}}}\n\nDocument:\n{{document_text}}"
    )


SYSTEM_PROMPT = "You extract fields from insurance documents and answer in JSON."
PROMPTED = ("life", "car", "travel", "health")  # property documents have fields but no prompt


def prompt_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(kind, prompt_template(kind)) for kind in PROMPTED], "doc_type string, template string")


def with_prompts(rows: DataFrame, type_col: str = "doc_type", text_col: str = "text") -> DataFrame:
    """Adds ``prompt`` and ``status``: ready, or failed for a type without a prompt (the prompt is null then)."""
    prompt = F.lit(None).cast("string")
    for kind in PROMPTED:
        prompt = F.when(F.col(type_col) == kind, fill_prompt(prompt_template(kind), F.col(text_col))).otherwise(prompt)
    rows = rows.withColumn("prompt", prompt)
    return rows.withColumn("status", F.when(F.col("prompt").isNull(), "failed").otherwise("ready"))


def fill_prompt(template: str, text: Column) -> Column:
    """A prompt template with ``{document_text}``; doubled braces stand for single ones."""
    head, _, tail = template.partition("{document_text}")
    plain = lambda t: t.replace("{{", "{").replace("}}", "}")
    return F.concat(F.lit(plain(head)), text, F.lit(plain(tail)))
