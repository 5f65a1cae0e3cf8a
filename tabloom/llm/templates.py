"""HTML extraction by equivalence-class template deduction.

Every page is read as tokens: structural ones (an element with its place in the tree) and text blocks at
their place. A token's occurrence vector has its count on every page of the host; tokens with equal
vectors form an equivalence class. Classes that enough of the host's pages have, and whose elements all
hang below one other class (or the root), are valid; nested into each other they are the host's
template. Text blocks that enough of the host's pages have at one place are the template's own text. What the
template leaves open are its slots. The slots decide first: the template's text is dropped, so is all of a slot
that holds more of the template's text than of the pages' own, and so is all outside the region of the
template where the pages' own text is. The region is found down the nested elements that stand once on a page, as
long as one of them holds ``REGION`` of the text. Within it names break ties: slots inside furniture (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments) are dropped, and where the page
marks its main text (an article element or the like), only slots inside it count.

Vectors are never built: a token's vector is two sums of page hashes weighted by count, so classes come
from one aggregation by (host, token), whatever the host's size. Templates are joined to pages by host,
hosts with over a thousandth of all pages (at most a thousand hosts) being spread by salt.

Defined cases: null or empty html gives the empty text; a null url is a host of its own; hosts of one or
two pages have no template and go by element and class names alone; repeated pages are pages of their
own, and where half of a host's pages or more are copies of others, text is no part of its template;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .page_tokens import read_page, text_token

PAGE, BODY, ELEMENT, TEXT = 0, 1, 2, 3
#: A class, or a text block at its place, must be on this share of the host's pages.
SUPPORT = 0.5
#: The share of the text around it that a template element must hold to be the region of main text.
REGION = 0.6
MASK31 = (1 << 31) - 1


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _prepared(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )


def page_tokens(rows: DataFrame) -> DataFrame:
    """``host``, ``page`` (hash), ``kind``, ``token``, ``parent``, ``n``, ``chars``: one row per distinct token of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for number, (host, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                mark, page = batch.column(1)[number].as_py(), read_page(html.as_py())
                out += [(host, mark, PAGE, 0, 0, 1, 0), (host, mark, BODY, text_token(0, "\n".join(b[0] for b in page.blocks)), 0, 1, 0)]
                out += [(host, mark, ELEMENT, path, parent, n, chars) for path, (parent, _, n, chars) in page.tokens.items()]
                texts: dict[tuple[int, int], list[int]] = {}
                for text, paths, _, _ in page.blocks:
                    found = texts.setdefault((text_token(paths[-1] if paths else 0, text), paths[-1] if paths else 0), [0, 0])
                    found[0] += 1
                    found[1] += len(text)
                out += [(host, mark, TEXT, token, parent, n, chars) for (token, parent), (n, chars) in texts.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "page", "kind", "token", "parent", "n", "chars"])

    keyed = rows.select("host", F.xxhash64("id", "url", "html").alias("page"), "html")
    return keyed.mapInArrow(run, "host string, page long, kind int, token long, parent long, n long, chars long")


def token_classes(tokens: DataFrame, support: float = SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens of valid classes (``host``, ``kind``, ``token``, ``parent``, ``c1``, ``c2``: the class), hosts with their ``pages``, and
    slots (``host``, ``parent``) that hold more of the template's text than of the pages' own."""
    weigh = lambda seed: F.sum(F.xxhash64("page", "n", F.lit(seed)).bitwiseAND(F.lit(MASK31)))
    counted = common.staged(
        tokens.groupBy("host", "kind", "token", "parent").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.max("n").alias("most"), weigh(1).alias("c1"), weigh(2).alias("c2")), "tokens"
    )
    bodies = counted.where(F.col("kind") == BODY).groupBy("host").agg(F.count(F.lit(1)).alias("bodies"))
    hosts = counted.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("host_pages")).join(bodies, "host", "left")
    hosts = common.staged(hosts, "hosts")
    enough = (F.col("pages") >= 3) & (F.col("pages") >= support * F.col("host_pages"))
    own_text = (F.col("kind") == TEXT) & enough & (2 * F.col("bodies") > F.col("host_pages"))  # most pages must differ
    known = counted.where(F.col("kind") >= ELEMENT).join(hosts, "host")
    masses = known.where(F.col("kind") == TEXT).groupBy("host", "parent").agg(F.sum(F.when(own_text, F.col("chars")).otherwise(-F.col("chars"))).alias("balance"))
    closed = common.staged(masses.where("balance > 0").select("host", "parent"), "closed")
    frequent = known.where(((F.col("kind") == ELEMENT) & enough) | own_text)
    chosen = common.staged(frequent.select("host", "kind", "token", "parent", "c1", "c2", F.when(F.col("most") == 1, F.col("chars")).otherwise(0).alias("mass")), "frequent")
    # nesting: all elements of a class that hang outside it must hang below one other class
    above = chosen.where(F.col("kind") == ELEMENT).select("host", F.col("token").alias("parent"), F.struct("c1", "c2").alias("outer"))
    hung = chosen.join(above, ["host", "parent"], "left").withColumn("outer", F.coalesce("outer", F.struct(F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"))))
    outside = hung.where(~F.col("outer").eqNullSafe(F.struct("c1", "c2")) & (F.col("kind") == ELEMENT))
    crossed = outside.groupBy("host", "c1", "c2").agg(F.min("outer").alias("lo"), F.max("outer").alias("hi")).where("lo <> hi").select("host", "c1", "c2")
    valid = chosen.join(crossed.withColumn("kind", F.lit(ELEMENT)), ["host", "kind", "c1", "c2"], "left_anti")
    return valid, hosts.select("host", F.col("host_pages").alias("pages"), "bodies"), closed


def host_templates(tokens: DataFrame, support: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """One template per host: ``elements`` (paths whose text is a slot), ``closed`` (those that hold the template's text) and ``texts``
    (that text); and the hosts. Its size is that of a page's structure: tokens that half of the host's pages have."""
    valid, hosts, closed = token_classes(tokens, support)
    marked = valid.join(closed.select("host", F.col("parent").alias("token"), F.lit(ELEMENT).alias("kind"), F.lit(True).alias("is_closed")), ["host", "kind", "token"], "left")
    pick = lambda test: F.collect_list(F.when(test, F.col("token")))
    made = marked.groupBy("host").agg(
        F.collect_list(F.when(F.col("kind") == ELEMENT, F.struct("token", "parent", "mass"))).alias("elements"), pick(F.col("is_closed")).alias("closed"), pick(F.col("kind") == TEXT).alias("texts"), F.count_distinct("c1", "c2").alias("classes")
    )
    return common.staged(made, "templates"), hosts


def text_region(elements: list[tuple[int, int, int]], share: float = REGION) -> int | None:
    """Down from the template's outermost element: the last one that holds the share of the text around it. Elements are (path, parent, characters)."""
    below: dict[int, list[tuple[int, int]]] = {}
    for path, parent, mass in elements:
        below.setdefault(parent, []).append((mass, path))
    here, mass = 0, sum(m for m, _ in below.get(0, []))
    while here in below:
        most, path = max(below[here])
        if not most or most < share * mass:
            break
        here, mass = path, most
    return here or None


def main_text(source: str, elements: set[int], closed: set[int], texts: set[int], region: int | None = None) -> tuple[str, int, int]:
    """Main text, the slots it came from, and the blocks that the template dropped."""
    page = read_page(source)
    open_, left_out = [], 0
    if region is not None and not page.tokens.get(region, (0, 0, 0, 0))[3]:
        region = None  # this page has no text of its own there
    for text, paths, furniture, main in page.blocks:
        slot = next((p for p in reversed(paths) if p in elements), 0)
        if slot in closed or region is not None and region not in paths or texts and text_token(paths[-1] if paths else 0, text) in texts:
            left_out += 1
        elif not furniture:
            open_.append((text, slot, main))
    if any(main for _, _, main in open_):
        open_ = [b for b in open_ if b[2]]
    return "\n".join(b[0] for b in open_), len({b[1] for b in open_}), left_out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT) -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars``, ``slots``, ``template_blocks``, ``template_classes``."""
    rows = _prepared(pages, id_col, url_col, html_col)
    templates, hosts = host_templates(page_tokens(rows), support)
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    step = max(8, total // 1000)
    hot = hosts.where(F.col("pages") > step).select("host", F.ceil(F.col("pages") / step).cast("int").alias("salts"))  # under 1000 hosts
    salted = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "url"), F.col("salts")).cast("int"), F.lit(0)))
    spread = templates.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
    dealt = salted.join(spread.select("host", "salt", "elements", "closed", "texts", "classes"), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, known = [], {}
            for host, html, *template in zip(batch.column(3).to_pylist(), batch.column(2), batch.column(4), batch.column(5), batch.column(6), strict=True):
                if host not in known:
                    nested = [(e["token"], e["parent"], e["mass"]) for e in template[0].as_py() or ()]
                    known = {host: ({e[0] for e in nested}, *(set(part.as_py() or ()) for part in template[1:]), text_region(nested))}
                found.append(main_text(html.as_py(), *known[host]))
            text, slots, left_out = zip(*found, strict=True) if found else ((), (), ())
            sizes = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), sizes, pa.array(slots, pa.int64()), pa.array(left_out, pa.int64()), batch.column(7)],
                ["id", "url", "text", "n_chars", "slots", "template_blocks", "template_classes"],
            )

    picked = dealt.select("id", "url", "html", "host", "elements", "closed", "texts", F.coalesce("classes", F.lit(0)).cast("long").alias("classes"))
    out = picked.mapInArrow(run, "id long, url string, text string, n_chars long, slots long, template_blocks long, template_classes long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
