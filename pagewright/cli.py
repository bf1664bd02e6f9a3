"""python -m pagewright.cli INPUT OUTPUT: scan a PDF, an image or a folder of images into a PDF."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.batches import scanned_and_counted
from pagewright.params import ScanParams
from pagewright.plans.pages import scan_images
from pagewright.session import durable, importable_on_workers, local_session
from pagewright.sinks.documents import assemble, export, page_artifacts
from pagewright.sources.images import collect_pages


def run(spark: SparkSession, source: str, output: str, params: ScanParams = ScanParams(), page_limit: int | None = None, page_size: str | None = "A4", images_out: str | None = None, border: bool = True, told: dict | None = None) -> DataFrame:
    """Scan a source to OUTPUT; told is given the counts of pages scanned and failed. Returns the pages that could not be read or scanned: name, page_no, error."""
    pages = durable(collect_pages(spark, source, page_limit).withColumn("page_id", F.col("page_no").cast("long")))
    counted, seen = scanned_and_counted(scan_images(pages, params))
    done = durable(counted).withColumn("page_no", F.col("page_id").cast("int"))
    if told is not None:
        told.update(seen.get)
    images = done.where("error is null")
    if images_out:
        export(page_artifacts(images, kind="jpg"), images_out)
    target = Path(output)
    export(assemble(images.withColumn("doc_id", F.lit("one")), page_size, border=border).withColumn("name", F.lit(target.name)), str(target.parent))
    return pages.select("name", "page_no").join(done.where("error is not null").select("page_no", "error"), "page_no").select("name", "page_no", "error")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--pages", type=int, help="most pages to scan")
    parser.add_argument("--page-size", default="A4", choices=["A4", "Letter", "image"])
    parser.add_argument("--images-out", help="folder for the scanned pages as JPEG")
    parser.add_argument("--no-border", action="store_true")
    parser.add_argument("--kernel", type=int, default=ScanParams().kernel)
    parser.add_argument("--scale", type=float, default=ScanParams().output_scale, help="how much larger than the source the pages become")
    parser.add_argument("--keep-borders", action="store_true", help="neither trim pages nor clean their borders")
    args = parser.parse_args(argv)
    spark = local_session()
    importable_on_workers(spark)
    told: dict = {}
    bad = run(spark, args.input, args.output, ScanParams(kernel=args.kernel, output_scale=args.scale, preserve_borders=args.keep_borders), args.pages, None if args.page_size == "image" else args.page_size, args.images_out, not args.no_border, told)
    for row in bad.collect():
        print(f"{row.name}, page {row.page_no + 1}: {row.error}")
    print(f"{told['scanned']} of {told['rows']} pages scanned, {told['failed']} failed")


if __name__ == "__main__":
    main()
