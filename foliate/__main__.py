"""Jobs: ``python -m foliate clean|route|evaluate|scan|extract ...``.

Readers and models are services outside this package: jobs that need them take their factory as ``module:name``.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from importlib import import_module

from pyspark.sql import SparkSession, functions as F

from foliate.config import CleanConfig
from foliate.operators import clean, evaluate, layout
from foliate.plans import jobs as jobs_
from foliate.runtime import clear_scratch, ensure_worker_imports, materialise
from foliate.sinks import results
from foliate.sources import documents, providers, routing


def named(place: str):
    """The object that ``module:name`` names."""
    module, _, name = place.partition(":")
    return getattr(import_module(module), name)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliate")
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("clean", help="saved documents -> cleaned blocks and document text")
    job.add_argument("input")
    job.add_argument("--output-json", required=True)
    job.add_argument("--drop-garbage", action="store_true")
    job = jobs.add_parser("route", help="list the files of a folder by kind")
    job.add_argument("input")
    job.add_argument("--output", required=True)
    job = jobs.add_parser("evaluate", help="score predictions (Parquet: filename, field, predicted) against ground truth")
    job.add_argument("--gt", required=True)
    job.add_argument("--predictions", required=True)
    job.add_argument("--output", required=True)
    job.add_argument("--file", help="one file only")
    job.add_argument("--run", default="run")
    job = jobs.add_parser("scan", help="files of all kinds -> blocks and documents")
    job.add_argument("input")
    job.add_argument("--output-dir", required=True)
    job.add_argument("--reader", action="append", default=[], help="kind=module:factory, once per kind")
    job.add_argument("--force-ocr", action="store_true")
    job.add_argument("--extraction-mode", choices=("frames", "audio", "both"), default="both")
    job = jobs.add_parser("extract", help="document texts (JSON) -> classified, extracted and validated results")
    job.add_argument("input")
    job.add_argument("--output", required=True)
    job.add_argument("--model", required=True, help="module:factory of a language model")
    opts = parser.parse_args(args)

    spark = SparkSession.builder.appName(f"foliate-{opts.job}").getOrCreate()
    ensure_worker_imports(spark)
    if opts.job == "clean":
        blocks = documents.to_blocks(documents.read_documents(spark, opts.input))
        done = clean.clean(blocks, replace(CleanConfig(), drop_garbage=opts.drop_garbage))
        results.cleaned_documents(blocks, done).write.mode("overwrite").json(opts.output_json)
        layout.document_text(done).write.mode("overwrite").json(f"{opts.output_json.rstrip('/')}_text")
        clear_scratch(spark)
    elif opts.job == "scan":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(opts.input).select("path", "content")
        readers = {kind: named(place) for kind, place in (r.split("=", 1) for r in opts.reader)}
        # read below for the documents too: files are read once
        blocks = materialise(providers.process_files(files, readers, opts.force_ocr, opts.extraction_mode))
        blocks.write.mode("overwrite").parquet(f"{opts.output_dir}/blocks")
        providers.document_rows(files.select("path"), blocks).write.mode("overwrite").json(f"{opts.output_dir}/documents")
        clear_scratch(spark)
    elif opts.job == "extract":
        texts = spark.read.json(opts.input).select("doc_id", F.col("document_text").alias("text"))
        records = materialise(jobs_.extracted(texts, named(opts.model)))
        error = results.try_save(results.save_results, records, opts.output)
        clear_scratch(spark)
        if error:
            print(f"results were not saved: {error}")
    elif opts.job == "route":
        routing.list_files(spark, opts.input).write.mode("overwrite").parquet(opts.output)
    else:
        truth = documents.read_truth(spark, opts.gt)
        truth = truth.filter(F.col("filename") == opts.file) if opts.file else truth
        facts = evaluate.score_fields(evaluate.truth_rows(truth), spark.read.parquet(opts.predictions))
        results.append_facts(facts, f"{opts.output}/facts", opts.run)
        lines = evaluate.report(results.load_facts(spark, f"{opts.output}/facts")).orderBy("section", "ord")
        lines.select("line").coalesce(1).write.mode("overwrite").text(f"{opts.output}/report")


if __name__ == "__main__":
    main()
