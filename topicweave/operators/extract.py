"""Text from captured web pages, as jobs over page tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicweave.functions.html import element_texts, first_element_text, page_text
from topicweave.operators.bounded import maybe_in
from topicweave.operators.curate import enrich, from_site, todo_rows

SLICE_ROWS = 256  # pages whose texts are held at once
DESCRIPTION = ("p", "class", "description")


def extract_pages(df: DataFrame, html: str, read: Callable[[str], str], out: str) -> DataFrame:
    """Apply a reader to each page in Arrow batches. A page that fails yields empty text and its error, and the job
    goes on. The HTML itself does not come back from Python."""
    rest = [f for f in df.schema.fields if f.name != html]
    schema = StructType([*rest, StructField(out, StringType()), StructField("error", StringType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            texts, errors = [], []
            for page in batch.column(html):
                try:
                    texts.append(read(page.as_py()) if page.is_valid else "")
                    errors.append(None)
                except Exception as e:  # one bad page must not end the job
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            cols = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*names, out, "error"]
            )

    return df.mapInArrow(run, schema)


def html_text(df: DataFrame, html: str, out: str = "text") -> DataFrame:
    """Visible text of each page."""
    return extract_pages(df, html, page_text, out)


def html_first(df: DataFrame, html: str, target=DESCRIPTION, out: str = "description") -> DataFrame:
    """Text of the first element with the given tag, and exactly the given attribute value; empty if there is none."""
    tag, attr, value = target
    return extract_pages(df, html, lambda page: first_element_text(page, tag, attr, value), out)


@F.udtf(returnType="place int, text string", useArrow=True)
class PageElements:
    """Table function: every element of a page with a tag as a row (place from 0, text); a null page has none. Arrow carries
    the pages; the form that takes whole Arrow columns cannot stand in a lateral join."""

    def eval(self, html: str, tag: str) -> Iterator[tuple[int, str]]:
        if html is not None and tag is not None:
            yield from enumerate(element_texts(html, tag))


def register_table_functions(spark: SparkSession) -> None:
    """Make ``page_elements(html, tag)`` known to SQL, for lateral joins."""
    spark.udtf.register("page_elements", PageElements)


def enrich_from_pages(
    articles: DataFrame,
    pages: DataFrame,
    done: DataFrame | None = None,
    domain: str | None = None,
    link: str = "link",
    url: str = "url",
    target=DESCRIPTION,
    out: str = "description",
) -> DataFrame:
    """Articles still to do, each with the text found on its page (empty when there is no page or it fails) and with the
    ``error`` of a page that could not be read.

    Site filter and anti-join come first, and only pages that an open article asks for reach the Python stage: by a
    bitmap of the wanted links' hashes, which is broadcast (its size is fixed) and lets through a few others. HTML is
    never shuffled; what is joined to the articles, exactly, is url and text.
    """
    todo = from_site(articles, link, domain) if domain else articles
    if done is not None:
        todo = todo_rows(todo, done, link)
    wanted = todo.select(F.col(link).alias(url)).where(F.col(url).isNotNull())
    texts = html_first(maybe_in(pages.select(url, "html"), wanted, url), "html", target, out)
    # several captures of one page: keep one text, found or not
    per_page = texts.groupBy(F.col(url).alias(link)).agg(F.max(out).alias(out), F.max("error").alias("error"))
    found = per_page.withColumn("error", F.when(F.col(out) == "", F.col("error")))
    return enrich(todo, found, link, out, ["error"])
