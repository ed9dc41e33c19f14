"""The page pipeline from the command line: python -m pageloom.plans.pages scans/*.png --weights best.pt"""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions.text import extension
from pageloom.plans import backends, stages
from pageloom.plans.config import Config
from pageloom.sources import readers, writers


def run(spark: SparkSession, path: str, config: Config, ocr=None, detector=None, llm=None, structure=backends.NoStructures) -> DataFrame:
    """Bundles of all images that path names (a file, a folder or a pattern); models as config names them."""
    services = functools.partial(backends.HttpModels, config)
    files = spark.read.format("binaryFile").load(path).filter(extension("path").isin(list(schemas.PAGE_EXTENSIONS)))
    pages = files.select(F.xxhash64("path").alias("page_id"), F.url_decode("path").alias("path"), "content")
    return stages.run_pages(pages, config, ocr or services, detector or functools.partial(backends.WeightsDetector, config), llm or services, structure)


def main(argv: list[str] | None = None, **models) -> None:
    args = readers.page_arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    config = replace(Config(), recognise_structures=args.ocsr, weights=args.weights, run_dir=args.run_dir or "runs/pipeline")
    made = run(spark, args.page, config, **models)
    for row in made.select(writers.report("summary").alias("report")).toLocalIterator():  # one page's text at a time
        print(row["report"], end="\n\n")


if __name__ == "__main__":
    main()
