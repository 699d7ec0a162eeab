"""Main-text extraction by consensus paths of a host.

1. Every page's containers are scored; the page votes, with the share of its
   score, for the generalised tag-class path of its best container.
2. Spark sums the votes by host and path (partial sums in the tasks, so a host
   with a third of all pages is a few rows by then) and keeps all of a host's paths
   that more than one page votes for: a host may have any number of templates.
3. The pages are read again and extracted with the path of their host that scores
   best on the page and in the votes; a page without a container of any of them
   uses its own best one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, arrow_map, pick, read
from divspark.llm.html_blocks import best_path, main_text, read_page

AT_ONCE = 64  # voted paths of one host that are sent to each of its pages


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and leading ``www.``; empty for a null url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, share): one vote a page; a page without text has none."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            path, share = best_path(read_page(html or "")[0])
            if path:
                rows.append((host, path, share))
        host, path, share = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()),
                                           pa.array(share, pa.float64())], ["host", "path", "share"])
    return arrow_map(pages.select("host", "html"), run, "host string, path string, share double")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the paths that more than one page of the host votes for, and their
    votes; of a host without any, the path with the most votes (ties: the less deep,
    then the smaller one)."""
    by_path = votes(pages).groupBy("host", "path").agg(F.sum("share").alias("votes"), F.count(F.lit(1)).alias("pages"))
    first = Window.partitionBy("host").orderBy((F.col("pages") > 1).desc(), F.round("votes", 6).desc(), F.col("path"))
    return (by_path.withColumn("k", F.row_number().over(first)).where("k = 1 OR pages > 1")
            .select("host", "path", "votes"))


def paths_here(pages: DataFrame) -> DataFrame:
    """(row, host, path): every path of a container of each page, once."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted({n.path for n in read_page(html or "")[1] if n.path}) for html in b.column("html").to_pylist()]
        at = pa.array([k for k, paths in enumerate(found) for _ in paths], pa.int32())
        return pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("host").take(at),
                                           pa.array([p for paths in found for p in paths], pa.string())],
                                          ["row", "host", "path"])
    return arrow_map(pages.select("row", "host", "html"), run, "row long, host string, path string")


def with_paths(ws: Workspace, pages: DataFrame, paths: DataFrame) -> DataFrame:
    """``pages`` with ``paths``, a map of the voted paths that a page may have to their votes.

    The few paths of an ordinary host go to all its pages.  Of a host with more than
    ``AT_ONCE`` each page gets those among its own containers, by a join on host and path;
    as the paths of other pages have no score on it, both ways give the same text.
    """
    entry = F.map_from_entries(F.collect_list(F.struct("path", "votes"))).alias("paths")
    sizes = ws.store(paths.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "sizes")
    many = sizes.where(F.col("n") > AT_ONCE).select("host")
    few = paths.join(sizes.where(F.col("n") <= AT_ONCE).select("host"), "host", "left_semi").groupBy("host").agg(entry)
    columns = [*pages.columns, "paths"]
    if many.isEmpty():
        return pages.join(few, "host", "left").select(*columns)
    rest = ws.store(pages.join(many, "host", "left_semi").withColumn("row", F.monotonically_increasing_id()), "many")
    own = paths_here(rest).join(paths, ["host", "path"]).groupBy("row").agg(entry)
    return (pages.join(many, "host", "left_anti").join(few, "host", "left").select(*columns)
            .unionByName(rest.join(own, "row", "left").select(*columns)))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page, or one without article text, has the empty text.  Pages
    without a url, or without a host in it, vote together.  Very long and very deeply nested
    pages are read whole, in time linear in their length.  Repeated ids keep one
    result per row; an empty table gives an empty result; extra columns are ignored.
    """
    ws = Workspace(df.sparkSession, "html")
    pages = pick(df, page_id=id_col, url=url_col, html=html_col)
    pages = pages.withColumn("host", host_of(F.col("url").cast("string")))
    pages = with_paths(ws, pages, ws.store(host_paths(pages), "paths"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html or "", dict(paths or ())) for html, paths in
                 zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    types = {c: df.schema[s].dataType.simpleString() for c, s in (("page_id", id_col), ("url", url_col))}
    return arrow_map(pages.select("page_id", "url", "html", "paths"), run,
                     f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
