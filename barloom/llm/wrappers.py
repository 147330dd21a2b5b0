"""Main text of pages by wrapper induction.

Each page is read once into text blocks and a skeleton: its tree of block elements without text, repeated neighbours taken as one node.
The skeletons of a host are few. The most frequent one is the host's reference; every other one is aligned with it by simple tree
matching, which gives the same slot to the same place in all pages of the host. A text that stands in one slot of nearly all different
pages of a host is constant and belongs to the template; what varies is content. Only hashes of texts are counted, over all pages; the
constant ones are few, as each stands in at least SHARE of a host's pages.

What varies is not all article: elements and names that mark menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments (``dom``) are left out, and where a page has an article element, or else a main element, with text, only blocks in it are
taken. Copies of a page count once when constants are sought, and hosts with few different pages have none.

Null html is empty, and a page without text gives an empty text. Every row gives a row, repeated rows too. Pages without a host (null or
odd urls) have no template. An empty table gives no rows. Other columns than page_id, url and html are not read, so none can clash.
Very long pages are read whole; elements below depth 64 count as part of the one above and keep their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm import dom
from barloom.session import stage, unstage

#: A text that stands in this share of the different pages of a host, in one slot, is template.
SHARE = 0.9
#: Different pages a host needs before anything counts as constant.
PAGES = 8

PARSED = "page_id long, url string, host string, shape string, skeleton string, blocks array<struct<node:int,text:string>>"


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname if url else None
    except ValueError:
        return None


def parsed_page(html: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(skeleton, blocks): the blocks are those of the article element, else of main, else all that is not marked as beside it."""
    page = dom.read(html)
    skeleton = dom.skeleton(page.root)
    article = [b for b in page.blocks if b[2]]
    main = article or [b for b in page.blocks if b[3]]
    return skeleton, [(node.slot, text) for node, text, _, _ in main or page.blocks]


def parsed(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, host, shape (name of its skeleton), skeleton, blocks; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                batch = big.slice(at, 128)
                found = [parsed_page(h.as_py()) for h in batch["html"]]
                yield pa.RecordBatch.from_arrays(
                    [batch["page_id"], batch["url"], pa.array([host_of(u.as_py()) for u in batch["url"]], pa.string()),
                     pa.array([xxhash.xxh3_128_hexdigest(s.encode("utf-8", "surrogatepass")) for s, _ in found], pa.string()),
                     pa.array([s for s, _ in found], pa.string()),
                     pa.array([[{"node": n, "text": t} for n, t in b] for _, b in found], pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())])))],
                    ["page_id", "url", "host", "shape", "skeleton", "blocks"])

    return stage(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, PARSED), "pages")


def alignments(shapes: DataFrame) -> DataFrame:
    """(host, shape, slots): for each node of a skeleton the node of the host's reference it matches, or -1.

    ``shapes`` has a row per host and shape: host, shape, skeleton, n. The reference is the most frequent one, of these the smallest.
    """
    reference = shapes.groupBy("host").agg(
        F.max_by("skeleton", F.struct("n", -F.length("skeleton"), "shape")).alias("reference"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [dom.simple_tree_matching(s.as_py(), r.as_py()) for s, r in zip(batch["skeleton"], batch["reference"])]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["shape"], pa.array(slots, pa.list_(pa.int32()))], ["host", "shape", "slots"])

    return shapes.join(reference, "host").select("host", "shape", "skeleton", "reference").mapInArrow(
        run, "host string, shape string, slots array<int>")


def constants(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(host, shape, template): the (node, hash of text) of a shape's blocks that are the same in nearly all pages of its host.

    Stored, so that the planner sees how small it is and need not move the pages to join it.
    """
    hashes = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("value"))))
    different = pages.filter("host is not null").withColumn("hashes", hashes).groupBy(
        "host", "shape", F.xxhash64("blocks").alias("content")).agg(F.first("hashes").alias("hashes"), F.first("skeleton").alias("skeleton"))
    different = stage(different, "different")
    shapes = different.groupBy("host", "shape").agg(F.count("*").alias("n"), F.first("skeleton").alias("skeleton"))
    aligned = stage(alignments(shapes), "aligned")
    hosts = different.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    values = different.select("host", "shape", F.explode("hashes").alias("at")).groupBy("host", "shape", "at.node", "at.value").agg(F.count("*").alias("n"))
    placed = values.join(aligned, ["host", "shape"]).select("host", F.get("slots", "node").alias("slot"), "value", "n").filter("slot >= 0")
    fixed = placed.groupBy("host", "slot", "value").agg(F.sum("n").alias("n")).join(hosts, "host").filter(F.col("n") >= share * F.col("pages"))
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("slot", "value")).alias("fixed"))
    template = F.transform("fixed", lambda x: F.struct((F.array_position("slots", x["slot"]) - 1).cast("int").alias("node"), x["value"].alias("value")))
    out = stage(aligned.join(fixed, "host").select("host", "shape", template.alias("template")), "template")
    for old in (different, aligned):
        unstage(old)
    return out


def main_text(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """Per page: page_id, url, text (blocks joined by a line feed), n_chars (its code points)."""
    known = parsed(pages)
    template = constants(known, share, least).withColumnsRenamed({"host": "of_host", "shape": "of_shape"})
    rows = known.join(template, (F.col("host") == F.col("of_host")) & (F.col("shape") == F.col("of_shape")), "left")
    content = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains(
        "template", F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("value"))), F.lit(False)))
    text = F.array_join(F.transform(content, lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


#: The pages of the given tables in DuckDB: an article element with h1 and p blocks, and few kinds of character references.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split(regexp_replace(x, '</?(?:p|h1)>', chr(1), 'g'), chr(1)),
  lambda y: regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(y, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda y: trim(regexp_replace(y, '[\s]+', ' ', 'g'))), lambda y: y <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""
