"""Main text of web pages by wrappers inferred as union-free regular expressions.

Pages of one host share a template. A page is a stream of blocks, each with the path of its containers; runs of
equal groups of blocks fold into one repeated group. The streams of all pages of a host are aligned with its most frequent
one: blocks that only some pages have become optional, texts that differ become slots. The wrapper's slots then tell where the
host keeps its articles: the deepest container that holds REGION_SHARE of the slots' text, links and constant texts not counted
and every different text once. The text of a page is what lies in that region; in a page without the region, or of a host with
fewer than MIN_PAGES different pages, it is what lies in its article or main element, else in its body. Names of tags and
classes only settle ties: they keep known frames (menus, adverts, comments and the like) out of the count and out of a region,
and let a region reach up to its article element, so that a headline is kept.

Wrappers come from all pages: a task merges those of equal streams, and aligned blocks are counted by host, place and text in
Spark, so that no task or group holds a host. Neither partitions nor the order or number of equal pages change a wrapper, but
for the choice of the most frequent stream, for which all rows count.

Null or empty html gives an empty text. Texts of any length are read whole. Unclosed tags end with their container.
Repeated rows stay; a null url belongs to the host of no name. Further columns are kept as
they are; an input column named text is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, table

MIN_PAGES = 3
#: Share of the text in slots that the region of articles holds.
REGION_SHARE = 0.75
#: Groups of up to so many blocks are folded where they repeat.
GROUP_BLOCKS = 6
#: Paths and texts that a task holds before it hands them on.
HELD = 100_000
#: Streams, or regions, of at most so many characters together are broadcast; beyond it they are joined by host, regions by salted host.
BROADCAST_BYTES = 32 << 20
SALTS = 32

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?/][^>]*>")
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select"}
_DROPPED = {"nav", "footer", "aside", "form", "button", "head", "dialog", "menu", *_RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *_DROPPED,
}
_FRAME = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|cookies?\w*|consent|notice|sidebar|side-bar|menu|nav|navbar|navigation|footer|header|masthead|"
    r"breadcrumbs?|comments?|commentlist|disqus|respond|replies|reply|promo\w*|sponsor\w*|share|sharing|social|related|recommended|newsletter|"
    r"subscribe|popup|modal|widget|toolbar|pagination|pager|contentinfo|complementary|search)(?:$|[\s_-])")
_SPACE = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('open' | 'close' | 'text', name or text, attributes) in page order; comments and raw elements are left out."""
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            yield "text", page[at:begin], ""
        if begin == size:
            return
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        tag = _TAG.match(page, begin)
        if not tag:
            yield "text", "<", ""
            at = begin + 1
            continue
        at = tag.end()
        name = (tag.group(2) or tag.group(5) or "").lower()
        if not name:
            continue
        closing, attributes = tag.group(1) or tag.group(4), tag.group(3) or tag.group(6) or ""
        if closing:
            yield "close", name, ""
            continue
        if name in _RAW and not attributes.endswith("/"):
            end = re.compile(rf"(?i)</{name}\s*>").search(page, at)
            at = end.end() if end else size
            continue
        yield "open", name, attributes
        if attributes.endswith("/") and name not in _VOID:
            yield "close", name, ""


def _is_frame(name: str, attributes: str, inside_article: bool) -> bool:
    if name in _DROPPED or name == "header" and not inside_article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return any(_FRAME.search(a or b or c) for _, a, b, c in _ATTRIBUTE.findall(attributes))


def blocks(page: str | None) -> list[tuple[str, bool, bool, str, int]]:
    """(text, inside a known frame, inside an article, path of containers, characters of links) of each block, in page order."""
    found: list[tuple[str, bool, bool, str, int]] = []
    stack: list[tuple[str, bool, bool, str]] = []  # name, is frame, is article, step of the path
    frames = articles = links = 0
    piece: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            found.append((text, frames > 0, articles > 0, "/".join(s[3] for s in stack if s[0] in _BLOCK), linked))
        linked = 0

    def leave() -> None:
        nonlocal frames, articles, links
        name, frame, article, _ = stack.pop()
        frames, articles, links = frames - frame, articles - article, links - (name == "a")

    for kind, name, attributes in tokens(page or ""):
        if kind == "text":
            piece.append(name)
            linked += len(name) if links else 0
        elif kind == "open":
            if name in _BLOCK:
                end_block()
            elif name == "br":
                piece.append(" ")
            if name in _VOID:
                continue
            if name in _BLOCK and name not in ("article", "main"):
                while stack and (stack[-1][0] == "p" or stack[-1][0] not in _BLOCK and any(s[0] == "p" for s in stack)):
                    leave()
                if name == "li" and stack and stack[-1][0] == "li":
                    leave()
            frame = _is_frame(name, attributes, articles > 0)
            article = name in ("article", "main") and not frame
            stack.append((name, frame, article, _step(name, attributes)))
            frames, articles, links = frames + frame, articles + article, links + (name == "a")
        else:
            if name in _BLOCK:
                end_block()
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    leave()
                leave()
    end_block()
    return found


def _step(name: str, attributes: str) -> str:
    """A container in a path: its name and classes, without digits, which often number pages."""
    classes = [a or b or c for key, a, b, c in _ATTRIBUTE.findall(attributes) if key.lower() == "class"] if "class" in attributes.lower() else []
    return ".".join([name, *re.sub("[0-9/.]+", "", " ".join(classes)).split()])


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def folded(found: list[tuple]) -> list[dict]:
    """The stream of blocks with runs of equal groups folded: path, text (None: several), digest of all its texts, its free characters, frame, repeated."""
    out: list[dict] = []
    for text, frame, _, path, linked in found:
        out.append({"path": path, "text": text, "digest": _digest(text), "chars": max(0, len(text) - linked), "frame": frame, "many": False})
        for width in range(1, GROUP_BLOCKS + 1):
            first, second = out[-2 * width:-width], out[-width:]
            if len(first) == width and [t["path"] for t in first] == [t["path"] for t in second]:
                out[-2 * width:] = [_repeated(x, y) for x, y in zip(first, second)]
                break
    return out


def _repeated(x: dict, y: dict) -> dict:
    return {"path": x["path"], "text": x["text"] if x["text"] == y["text"] else None, "digest": _digest(f"{x['digest']} {y['digest']}"),
            "chars": x["chars"] + y["chars"], "frame": x["frame"] and y["frame"], "many": True}


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (in order of their second part) in which the first part grows too."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(ends, i)
        ends[k:k + 1], last[k:k + 1] = [i], [n]
        before.append(last[k - 1] if k else -1)
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def align(stream: Sequence[str], page: Sequence[str]) -> dict[int, int]:
    """For blocks of a page (paths) the block of the stream that each corresponds to, in growing order of both.

    Equal ends are paired, then blocks of the same path and number of that path in the longest order common to both, then
    likewise what lies between them, until nothing between has a path in common.
    """
    found: dict[int, int] = {}
    between = [(0, len(stream), 0, len(page))]
    while between:
        i, j, k, m = between.pop()
        while i < j and k < m and stream[i] == page[k]:
            found[k] = i
            i, k = i + 1, k + 1
        while i < j and k < m and stream[j - 1] == page[m - 1]:
            j, m = j - 1, m - 1
            found[m] = j
        seen: Counter = Counter()
        numbered: dict[tuple[str, int], int] = {}
        for x in range(i, j if k < m else i):
            numbered[stream[x], seen[stream[x]]] = x
            seen[stream[x]] += 1
        seen, pairs = Counter(), []
        for y in range(k, m if numbered else k):
            x = numbered.get((page[y], seen[page[y]]))
            seen[page[y]] += 1
            if x is not None:
                pairs.append((x, y))
        for x, y in _longest(pairs) + [(j, m)] if pairs else []:
            if x < j:
                found[y] = x
            between.append((i, x, k, y))
            i, k = x + 1, y + 1
    return found


def places(stream: Sequence[str], page: Sequence[str]) -> list[tuple[int, bool, int, int]]:
    """Place in the wrapper of each block of a page: number in the stream and True; or, for a block of no counterpart, the
    number that it stands before, False, its number among those of its path there, and its distance from the last counterpart."""
    found, out = align(stream, page), []
    at = gap = 0
    seen: Counter = Counter()
    for n, path in enumerate(page):
        if n in found:
            out.append((found[n], True, 0, 0))
            at, gap, seen = found[n] + 1, 0, Counter()
        else:
            out.append((at, False, seen[path], gap))
            seen[path] += 1
            gap += 1
    return out


def _gather(held: dict, host: str, page: str | None) -> int:
    """Adds a page to its host's pages of the same stream; returns by how many paths and texts they grew. A page without blocks teaches nothing."""
    stream = folded(blocks(page))
    if not stream:
        return 0
    key = host, tuple(t["path"] for t in stream)
    grown = 0
    if key not in held:
        held[key] = {"n": 0, "frames": [True] * len(stream), "many": [False] * len(stream), "seen": [{} for _ in stream], "pages": set()}
        grown = len(stream)
    part = held[key]
    part["n"] += 1
    for n, t in enumerate(stream):
        part["frames"][n] &= t["frame"]
        part["many"][n] |= t["many"]
        grown += t["digest"] not in part["seen"][n]
        part["seen"][n].setdefault(t["digest"], (t["chars"], t["text"]))
    part["pages"].add(_digest(" ".join(str(t["digest"]) for t in stream)))
    if len(part["pages"]) > MIN_PAGES:
        part["pages"].remove(max(part["pages"]))
    return grown


def _stream_id(paths: Sequence[str]) -> int:
    return _digest("\n".join(paths))


def infer_wrapper(pages: list[str]) -> list[dict]:
    """The wrapper of pages of one host that are at hand: path, text (None: a slot or several), its different texts' free characters, slot, frame, repeated, optional."""
    held: dict = {}
    for page in pages:
        _gather(held, "", page)
    stream = max(((part["n"], _stream_id(paths), paths) for (_, paths), part in held.items()), default=(0, 0, ()))[2]
    total = sum(part["n"] for part in held.values())
    found: dict[tuple, dict] = {}
    for (_, paths), part in held.items():
        for n, (at, own, nth, gap) in enumerate(places(stream, paths)):
            t = found.setdefault((at, own, paths[n], nth), {"n": 0, "gap": gap, "frame": True, "many": False, "seen": {}})
            t["n"] += part["n"]
            t["gap"] = min(t["gap"], gap)
            t["frame"] &= part["frames"][n]
            t["many"] |= part["many"][n]
            t["seen"] |= part["seen"][n]
    ordered = sorted(found.items(), key=lambda x: (x[0][0], x[0][1], x[1]["gap"], x[0]))
    return [{"path": key[2], "text": next(iter(t["seen"].values()))[1] if len(t["seen"]) == 1 else None, "chars": sum(c for c, _ in t["seen"].values()),
             "slot": len(t["seen"]) > 1, "frame": t["frame"], "many": t["many"], "optional": t["n"] < total} for key, t in ordered]


def expression(wrapper: list[dict]) -> str:
    """The wrapper as a regular expression over blocks: # is a slot or several texts, + repeated, ? optional."""
    return " ".join(f"({t['path']}:{'#' if t['text'] is None else json.dumps(t['text'], ensure_ascii=False)}){'+' if t['many'] else ''}{'?' if t['optional'] else ''}" for t in wrapper)


def region(wrapper: list[dict]) -> str | None:
    """Path of the container that holds the articles; None where no container below the body stands out."""
    mass: Counter = Counter()
    for t in wrapper:
        if not t["frame"] and (t["slot"] or t["optional"]):
            steps = t["path"].split("/")
            for n in range(1, len(steps)):
                mass["/".join(steps[:n])] += t["chars"]
    total = max(mass.values(), default=0)
    fit = [p for p, chars in mass.items() if total and chars >= REGION_SHARE * total]
    return _raised(max(fit, key=lambda p: (p.count("/"), mass[p], p), default=""))


def _raised(best: str) -> str | None:
    """The container, or its next article or main element above; None for the body or what lies above."""
    steps = best.split("/")
    for n in range(len(steps) - 1, 0, -1):
        if steps[n - 1].split(".")[0] in ("article", "main"):
            best = "/".join(steps[:n])
            break
    return best if best.split("/")[-1].split(".")[0] not in ("", "html", "body") else None


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))


#: Pages of one host and stream, as a task met them: how many, up to MIN_PAGES different ones, and by block the different texts.
_PART = ("host string, stream long, n long, paths array<string>, frames array<boolean>, many array<boolean>, pages array<long>, "
         "block array<int>, digest array<long>, chars array<long>")


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}

    def handed_on() -> pd.DataFrame:
        rows = []
        for (host, paths), part in held.items():
            texts = [(n, digest, chars) for n, seen in enumerate(part["seen"]) for digest, (chars, _) in seen.items()]
            rows.append((host, _stream_id(paths), part["n"], list(paths), part["frames"], part["many"], list(part["pages"]), *map(list, zip(*texts))))
        held.clear()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PART.split(", ")])

    size = 0
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"]):
            size += _gather(held, host, page)
            if size > HELD:
                yield handed_on()
                size = 0
    if held:
        yield handed_on()


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """The wrappers of all hosts of MIN_PAGES different pages, from all their pages, a row for each block.

    host; place (at, own, gap, path, nth, as in places; in this order they make the expression); texts, how many different ones
    (one: constant, more: a slot), and their free characters; n pages of total that have it; frame; many.
    """
    parts = cut(pages.where("html is not null").select(_host().alias("host"), "html").mapInPandas(_parts, _PART))
    streams = parts.groupBy("host", "stream").agg(F.sum("n").alias("n"), F.first("paths").alias("paths"))
    different = parts.select("host", F.explode("pages").alias("page")).groupBy("host").agg(F.count_distinct("page").alias("pages"))
    best = streams.groupBy("host").agg(F.max_by("paths", F.struct("n", "stream")).alias("best"), F.sum("n").alias("total"))
    best = cut(best.join(different.where(F.col("pages") >= MIN_PAGES), "host", "left_semi"))
    size = best.agg(F.sum(F.length(F.array_join("best", "/")) + F.length("host")).alias("n")).first()["n"] or 0

    @F.pandas_udf("array<struct<at:int,own:boolean,nth:int,gap:int>>")
    def placed(streams: pd.Series, found: pd.Series) -> pd.Series:
        names = ("at", "own", "nth", "gap")
        return pd.Series([[dict(zip(names, p)) for p in places(list(s), list(f))] for s, f in zip(streams, found)], dtype=object)

    # streams of many hosts are joined without salt, which would copy them; a host of many streams is split by the session's handling of skew
    rows = parts.join(F.broadcast(best) if size <= BROADCAST_BYTES else best, "host").withColumn("place", placed("best", "paths"))
    # pages of a block are counted once a part, not once a text
    block = F.explode(F.transform(F.sequence(F.lit(0), F.size("paths") - 1), lambda i: F.struct(
        F.get("place", i).alias("p"), F.get("paths", i).alias("path"), F.get("frames", i).alias("frame"), F.get("many", i).alias("many"))))
    key = ["host", "at", "own", "path", "nth"]
    blocks_of = rows.select("host", "n", "total", block.alias("b")).select("host", "n", "total", "b.p.*", "b.path", "b.frame", "b.many").groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("total").alias("total"), F.min("gap").alias("gap"), F.min("frame").alias("frame"), F.max("many").alias("many"))
    text = F.explode(F.arrays_zip("block", "digest", "chars")).alias("t")
    texts = rows.select("host", "place", "paths", text).select("host", F.get("place", F.col("t.block")).alias("p"), F.get("paths", F.col("t.block")).alias("path"), "t.digest", "t.chars")
    texts = texts.select("host", "p.at", "p.own", "path", "p.nth", "digest", "chars").groupBy(*key, "digest").agg(F.max("chars").alias("chars"))
    texts = texts.groupBy(*key).agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"))
    return blocks_of.join(texts, key).select("host", "at", "own", "gap", "path", "nth", "texts", "chars", "n", "total", "frame", "many")


def host_regions(wrappers: DataFrame) -> DataFrame:
    """(host, region) of the wrappers' hosts whose articles stand out: what region finds in one wrapper."""
    mass = wrappers.where("not frame and (texts > 1 or n < total)").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    steps = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/")))
    mass = mass.where(F.size(steps) > 1).select("host", above.alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    most = mass.groupBy("host").agg(F.max("chars").alias("most"))
    fit = mass.join(most, "host").where((F.col("most") > 0) & (F.col("chars") >= REGION_SHARE * F.col("most")))
    best = fit.groupBy("host").agg(F.max(F.struct(F.size(steps).alias("depth"), "chars", "path")).alias("b"))

    @F.pandas_udf("string")
    def raised(paths: pd.Series) -> pd.Series:
        return paths.map(_raised)

    return best.select("host", raised(F.col("b.path")).alias("region")).where("region is not null")


def main_text(page: str | None, within: str | None = None) -> str:
    """Blocks in the host's region, or in the page's own article, or in its body; known frames are left out."""
    found = [b for b in blocks(page) if not b[1]]
    inside = [b[0] for b in found if within and (b[3] == within or b[3].startswith(within + "/"))]
    inside = inside or [b[0] for b in found if b[2]]
    return "\n".join(inside or [b[0] for b in found])


def extract_text(pages: DataFrame) -> DataFrame:
    """All columns of pages and text."""
    regions = cut(host_regions(learn_wrappers(pages)).select(F.col("host").alias("__host"), F.col("region").alias("__region")))
    size = regions.agg(F.sum(F.length("__region") + F.length("__host")).alias("n")).first()["n"] or 0
    keyed = pages.withColumn("__host", _host())
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(regions), "__host", "left")
    else:
        salted = regions.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")

    @F.pandas_udf("string")
    def text(htmls: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, w) for h, w in zip(htmls, within)], dtype=object)

    name = "text"
    return joined.withColumn("__text", text("html", "__region")).select(
        *[c for c in pages.columns if c != name], F.col("__text").alias(name))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
