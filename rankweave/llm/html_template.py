"""Main text of web pages by deducing the template of their host.

A page is read as tokens: its tags, told apart by their path and by class and id.
For every token of a host the pages are summed into a signature of its occurrence
vector: how often it occurs on which page. Tokens with equal vectors form an
equivalence class, for what the template writes together occurs together. Classes
of two tokens or more, found on enough pages, are valid; by their paths they nest,
which gives the template of the host: a tree whose tokens open slots. A slot holds
the text below its token and no deeper token of the template. Per slot the text, the
text in links and whether it ever changes are known from all pages of the host.

What the template marks as article or main is kept, less slots that never change. If
it marks nothing, every slot that changes and is link-poor is kept. A page then
yields its blocks in kept slots, less what is marked as menus, notices, adverts,
forms, comments and the like. Hosts with few pages, and pages without any of their
host's slots, are judged by the same marks on the page alone.

Signatures are sums over rows, so a hot host is pre-aggregated in every task. Only
one short row per host is joined back to the pages; the pages are not moved if
those rows are proven small, and salted otherwise.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, whole
from rankweave.llm.url_rules import host_of
from rankweave.session import written

#: Fewest pages that make a template, and the share of a host's pages a valid class is on.
SUPPORT, SHARE = 3, 0.3
#: Rows of host slots sent to every task at most; more hosts are joined by shuffle, salted this often.
MAX_SENT, SALTS = 50_000, 64
#: Characters of these rows at most.
MAX_SENT_CHARS = 16_000_000

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img input embed source track area map button select option label svg canvas object "
                   "link meta base param col".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
DROPPED = frozenset("head nav footer aside form script style textarea title noscript template iframe xmp button select option "
                    "svg canvas object menu dialog search".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
                "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
NOISE = frozenset("ad ads adbox adslot adunit adblock adbanner banner promo promos promotion promotions consent notice notices notification "
                  "notifications gdpr menu menus nav footer replies reply share sharing social related subscribe subscription popup modal "
                  "login signup search widget widgets toolbar pagination masthead".split())
#: A word of a class or id that starts like this marks noise too.
NOISE_STEMS = ("advert", "sponsor", "cookie", "navbar", "navigation", "breadcrumb", "sidebar", "comment", "disqus", "newsletter")
#: Names of what a container has, lacks or is beside.
ABOUT_OTHERS = ("has-", "have-", "with-", "no-", "without-", "is-", "tag-", "tagged-", "category-", "cat-", "topic-", "type-", "format-")
#: Words of containers whose text is not the article, however long it is.
OTHERS_TEXT = ("comment", "disqus", "repl", "cookie", "consent", "gdpr", "advert", "sponsor", "ad", "ads")
CONTENT_TAGS = frozenset(("article", "main"))

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(?P<bad>/?[a-zA-Z])[^>]*+>|<[!?/][^>]*+>",
    re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[a-z]+")

TOKENS = "_host string, _page long, token string, n long, chars long, links long, words long"
TEXTS = "_id long, _url string, text string, n_chars long"


class Element:
    #: noise: '' for none, '!' by tag or attribute, else the path of the outermost element whose class words mark it.
    __slots__ = ("tag", "path", "noise", "content")

    def __init__(self, tag, path, noise, content):
        self.tag, self.path, self.noise, self.content = tag, path, noise, content


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(source)} if source.strip(" /\n\t\r") else {}


def opened(tag: str, attrs: dict[str, str], parent: Element | None, cleared: frozenset[str] = frozenset()) -> Element:
    marks = " ".join(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower().split())
    inside = parent is not None and parent.content
    above, path = (parent.noise, parent.path) if parent else ("", "")
    own = path if tag in INLINE else f"{path}/{tag}" + "".join(f".{w}" for w in marks.split())
    noise = "!" if tag in DROPPED or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower() else ""
    marked = tag in CONTENT_TAGS or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
    # Class words do not make noise of what is marked as the article; an article in an article may be a comment.
    if marks and not noise and tag not in ("html", "body", "main") and not (marked and "/article" not in path) and own not in cleared:
        words = WORD.findall(" ".join(m for m in marks.split() if not m.startswith(ABOUT_OTHERS)))
        if not NOISE.isdisjoint(words) or any(w.startswith(NOISE_STEMS) for w in words) or ("header" in words and not inside):
            noise = "!" if tag in INLINE else own
    if tag == "header" and not inside:
        noise = "!"
    return Element(tag, own, above or noise, inside or marked)


def blocks(source: str, cleared: frozenset[str] = frozenset()):
    """Yield (path, noise, content, text, characters in links) of each block; a tag alone has text ''."""
    stack: list[Element] = []
    texts: list[str] = []
    linked = at = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(texts).split())
        top = next((e for e in reversed(stack) if e.tag not in INLINE), None)
        block = (top.path if top else "", top.noise if top else "", top.content if top else False, text, min(linked, len(text)))
        texts.clear()
        linked = 0
        return block

    def take(text: str):
        nonlocal linked
        if text and not (stack and stack[-1].noise and stack[-1].tag in INLINE):
            decoded = html.unescape(text) if "&" in text else text
            texts.append(decoded)
            if any(e.tag == "a" for e in reversed(stack)):
                linked += len(decoded)

    lowered = None
    for_match, n = TAG.search, len(source)
    while at < n:
        m = for_match(source, at)
        if m is None:
            take(source[at:])
            break
        take(source[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        tag = name.lower()
        if m["end"]:
            if tag == "br":
                texts.append(" ")
                continue
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if place is None or (tag in INLINE and any(e.tag not in INLINE for e in stack[place:])):
                continue
            if tag not in INLINE:
                if (block := flush())[3]:
                    yield block
            del stack[place:]
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag not in INLINE and tag not in RAW:
            if (block := flush())[3]:
                yield block
        if tag in CLOSES_P:
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "p"), None)
            if place is not None:
                del stack[place:]
        if tag in SELF_CLOSING:
            shut, scope = (x.split() for x in SELF_CLOSING[tag])
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in shut:
                    del stack[k:]
        element = opened(tag, attributes(m["attrs"]), stack[-1] if stack else None, cleared)
        if tag in VOID:
            if tag not in INLINE:
                yield (element.path, element.noise, element.content, "", 0)
            continue
        if tag in RAW:
            if lowered is None:
                lowered = source.lower() if source.isascii() else re.sub(r"[A-Z]+", lambda x: x[0].lower(), source)
            end = lowered.find(f"</{tag}", at)
            close = source.find(">", end) if end >= 0 else -1
            at = n if close < 0 else close + 1
            yield (element.path, element.noise, element.content, "", 0)
            continue
        stack.append(element)
        if tag not in INLINE:
            yield (element.path, element.noise, element.content, "", 0)
    if (block := flush())[3]:
        yield block


def wrongly_noise(found: list[tuple]) -> str | None:
    """The element that class words mark as noise although it holds what the page is about: nearly all text, or its heading and most text."""
    if any(b[2] and b[3] and not b[1] for b in found):
        return None
    roots: dict[str, list] = {}
    total = 0
    for path, noise, _, text, linked in found:
        if text and noise != "!":
            total += len(text)
            if noise:
                r = roots.setdefault(noise, [0, 0, False])
                r[0], r[1], r[2] = r[0] + len(text), r[1] + linked, r[2] or path.rpartition("/")[2].partition(".")[0] == "h1"
    for root, (chars, linked, heading) in roots.items():
        others = any(w.startswith(OTHERS_TEXT[:-2]) or w in OTHERS_TEXT for w in WORD.findall(root.rpartition("/")[2]))
        if 2 * linked < chars and (2 * chars >= total if heading else 10 * chars >= 9 * total and not others):
            return root
    return None


def judged(source: str) -> list[tuple]:
    """The blocks of a page; a wrapper of nearly all its text is no noise, whatever its class words are."""
    cleared: frozenset[str] = frozenset()
    while (wrapper := wrongly_noise(found := list(blocks(source, cleared)))) is not None:
        cleared |= {wrapper}
    return found


def under(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def above(path: str, known) -> str | None:
    """The longest path in `known` that is `path` or holds it."""
    while path and path not in known:
        path = path.rpartition("/")[0]
    return path or None


def main_text(source: str, slots: str | None) -> str:
    """Blocks in the slots that its host keeps, else in the page's own article, else all that is not marked as noise.

    `slots` has a line for each slot where keeping ('+') or leaving out ('-') begins.
    """
    found = [b for b in judged(source) if b[3] and not b[1]]
    flags = {line[1:]: line[0] == "+" for line in slots.split("\n")} if slots else {}
    inside = [b for b in found if flags.get(above(b[0], flags), False)] if slots else []
    inside = inside or [b for b in found if b[2]] or found
    return "\n\n".join(b[3] for b in inside)


def page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) -> one row per token of a page: occurrences, text directly below it, a hash of that text."""
    schema = arrow_schema(TOKENS)
    for batch in batches:
        rows = []
        for host, page, source in zip(*(c.to_pylist() for c in batch.columns)):
            seen: dict[str, list] = {}
            for path, noise, content, text, linked in judged(source):
                if not path:
                    continue
                token = ("!" if noise else "+" if content else " ") + path
                t = seen.setdefault(token, [0, 0, 0, 0])
                if text:
                    t[1], t[2], t[3] = t[1] + len(text), t[2] + linked, hash_text(t[3], text)
                else:
                    t[0] += 1
            rows += [(host, page, token, *t) for token, t in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def hash_text(before: int, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode(), before & 0x7FFFFFFF) >> 1


def host_tokens(pages: DataFrame) -> DataFrame:
    """pages(_host, _page, _html) -> one row per host and token, with the signature of its occurrence vector."""
    tokens = pages.mapInArrow(page_tokens, TOKENS)
    return tokens.groupBy("_host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("_page", "n")).alias("signature"), F.sum("n").alias("n"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        (F.min("words") != F.max("words")).alias("changes"))


def template(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """_host, frame: the tokens of the valid equivalence classes of each host, a line each: pages, occurrences, token.

    A class is valid if it has two tokens or more and is on enough pages, which bounds it
    by what one page can hold. Tokens of no valid class (paragraphs of an article, say,
    whose number varies) are what fills the slots.
    """
    known = tokens.join(sizes, "_host").filter((F.col("host_pages") >= SUPPORT) & (F.col("pages") >= SHARE * F.col("host_pages")))
    line = F.concat_ws(" ", "pages", "n", "token")
    classes = known.groupBy("_host", "signature", "pages").agg(F.collect_list(line).alias("lines")).filter("size(lines) > 1")
    return classes.groupBy("_host").agg(F.concat_ws("\n", F.array_sort(F.flatten(F.collect_list("lines")))).alias("frame"))


def frame_of(frame: str) -> dict[str, tuple[str, int, int]]:
    """path -> mark, pages, occurrences."""
    out = {}
    for line in frame.split("\n"):
        pages, n, token = line.split(" ", 2)
        out[token[1:]] = (token[0], int(pages), int(n))
    return out


FILLED = "_host string, slot string, mark string, chars long, links long, changes boolean"


def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, chars, links, changes, frame) -> the slot that each token's text is in, by the nesting of the paths."""
    schema, last, frame = arrow_schema(FILLED), None, {}
    for batch in batches:
        rows = []
        for host, token, pages, chars, links, changes, source in zip(*(c.to_pylist() for c in batch.columns)):
            if source != last:
                last, frame = source, frame_of(source)
            slot = above(token[1:], frame)
            if slot is not None:
                rows.append((host, slot, token[0], chars, links, changes or pages < frame[slot][1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


CHOSEN = "_host string, slots string"


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, filled slots, frame) -> host, slots to keep and to leave out, where one or the other begins.

    What the template marks as article or main is kept, less slots that never change. If it
    marks nothing, all slots are kept that change and are link-poor, or are headings that change.
    """
    for batch in batches:
        rows = []
        for host, slots, source in zip(*(c.to_pylist() for c in batch.columns)):
            frame = frame_of(source)
            plus = {p for p, f in frame.items() if f[0] == "+"}
            marked = [p for p in plus if above(p.rpartition("/")[0], plus) is None]
            # An article that comes once a page is meant rather than what holds it.
            single = [p for p in plus if re.match(r"article\b", p.rpartition("/")[2]) and frame[p][2] == frame[p][1]]
            roots = set(single or marked)
            total, of_marks = sum(s["chars"] for s in slots), sum(s["marked"] for s in slots)
            if not roots and 2 * of_marks > total:
                continue  # marked, but by another path on each page: pages tell their own article
            flags = dict.fromkeys(roots, True)
            for s in slots:
                path = s["slot"]
                if roots:
                    if above(path, roots):
                        flags[path] = s["changes"]
                else:
                    heading = re.match(r"h[1-6]\b", path.rpartition("/")[2])
                    flags[path] = s["changes"] and (heading is not None or 2 * s["links"] < s["chars"])
            out = []
            for path in sorted(flags):
                up = above(path.rpartition("/")[0], flags)
                if flags[path] != (up is not None and flags[up]):
                    out.append(("+" if flags[path] else "-") + path)
            if out:
                rows.append((host, "\n".join(out)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=arrow_schema(CHOSEN))


def beside(rows: DataFrame, by_host: DataFrame, salt: str, how: str) -> DataFrame:
    """Rows with what is known of their host: sent to every task if proven small, else joined by salted shuffle."""
    value = by_host.columns[-1]
    size = by_host.limit(MAX_SENT + 1).agg(F.count("*"), F.sum(F.length(value))).head()
    if size[0] <= MAX_SENT and (size[1] or 0) <= MAX_SENT_CHARS:
        return rows.join(F.broadcast(by_host), "_host", how)
    salts = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salts, ["_host", "_salt"], how)


def host_slots(pages: DataFrame) -> DataFrame:
    """pages(_host, _page, _html) -> _host, slots: what is kept of the template's slots, for each host."""
    tokens = written(host_tokens(pages), "host-tokens")
    sizes = pages.groupBy("_host").agg(F.count("*").alias("host_pages"))
    frames = written(template(tokens, sizes), "host-frames")
    texts = tokens.filter((F.col("chars") > 0) & ~F.startswith("token", F.lit("!"))).select("_host", "token", "pages", "chars", "links", "changes")
    filled = beside(texts, frames, "token", "inner").select(*texts.columns, "frame").mapInArrow(fill, FILLED)
    slots = filled.groupBy("_host", "slot").agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("changes").alias("changes"),
        F.sum(F.when(F.col("mark") == "+", F.col("chars")).otherwise(0)).alias("marked"))
    one = F.struct("slot", "chars", "links", "changes", "marked")
    return written(slots.groupBy("_host").agg(F.collect_list(one).alias("slots")).join(frames, "_host").mapInArrow(choose, CHOSEN), "host-slots")


def extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, html, slots) -> id, url, text, n_chars."""
    schema = arrow_schema(TEXTS)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            own, url, source, slot = (c.to_pylist() for c in batch.slice(start, 256).columns)
            texts = [main_text(s, p) for s, p in zip(source, slot)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((own, url, texts, map(len, texts)), schema)], schema=schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page.

    Null html is empty and gives the empty text; a null url belongs to the host ''.
    Repeated rows are pages of their own. Nothing is cut off. Other columns are not
    read; an empty table gives no rows.
    """
    own = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), whole(F.col(html_col)).alias("_html"))
    own = own.withColumn("_host", host_of(F.col("_url")))
    slots = host_slots(own.select("_host", F.col("_id").alias("_page"), "_html"))
    told = beside(own, slots, "_id", "left")
    return told.select("_id", "_url", "_html", "slots").mapInArrow(extract_rows, TEXTS).toDF(id_col, url_col, "text", "n_chars")
