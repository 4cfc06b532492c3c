"""HTML main text by wrappers: union-free regular expressions inferred from pages of the same host.

A page is a stream of tags and texts. From up to SAMPLE pages of a host one wrapper is inferred: runs of equal groups in
a page become a repeated group; the streams are aligned one after the other, what only one side has becomes an optional
group, and texts that differ become slots, while texts alike in all pages stay constants of the template. A wrapper decides
what is main text: a slot belongs to the article if most of the sampled texts in it do by the elements round them (`roles`).
So do constants inside an article or main element. On hosts without these, blocks of nothing but constants seen on
CONSTANT pages or more are template if they lie before the first or after the last slot of the article, and go.

A page is matched against its host's wrapper from left to right. Pages that don't match give, up to SAMPLE a host, a further
wrapper, ROUNDS in all; what none matches (or what is alone on its host) is read by the elements alone, and so is a page
on which a wrapper finds nothing.

Wrappers come from a fixed number of pages a host, so no task ever holds a host. They reach the pages by a broadcast if
they measure less than SENT bytes, else by a join that Spark splits where a host is large.
"""

from __future__ import annotations

import difflib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut, ship

#: Pages that a wrapper is inferred from, the longest repeated group in tokens, and wrappers of a host.
SAMPLE, LONGEST, ROUNDS = 8, 16, 4
#: Pages on which a text must be the same to be template.
CONSTANT = 3
#: Nodes, after repeats are folded, of the longest page that takes part in an alignment (its time grows with the square), and bytes of wrappers that are broadcast.
ALIGNED, SENT = 4000, 8 << 20

# Element names of HTML by what they mean here.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}
APART = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "label", "fieldset"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words of class, id and role that mark menus, notices, adverts, comments and the like.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer",
    "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "respond",
    "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that go with them in the names of one element, such as a comment list.
HOLDER_WORDS = {
    "area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "group", "icons", "inner", "item", "items", "label", "link", "links", "list", "outer", "panel", "posts", "row", "section", "signup",
    "slot", "top", "bottom", "left", "right", "unit", "wrap", "wrapper",
}
#: Of these only adverts are told by the name of an element that holds a text itself.
ADVERT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "promo", "promoted", "sponsor", "sponsored"}
TEXTUAL = {"a", "abbr", "b", "blockquote", "caption", "cite", "code", "dd", "dt", "em", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "i", "img", "li", "p", "pre", "q", "s", "small", "span", "strong", "sub", "sup", "td", "th", "tr", "u"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.DOTALL)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

#: A token: (symbol, element name, or "" for a text; its text or the names of its class, id and role).
Token = tuple[str, str, str]


def tokens(page: str) -> list[Token]:
    """Tags and texts in order, without comments and declarations; a raw element's content is left out."""
    out: list[Token] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if name:
            if m[1]:
                out.append(("/" + name, name, ""))
                continue
            named = " ".join(a or b or c for _, a, b, c in _NAMED.findall(m[3])) if "=" in m[3] else ""
            out.append((f"{name}.{re.sub('[0-9]+', '#', named)}" if named else name, name, named.lower()))
            if name in RAW and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close.end() if close else n if name != "title" else at
                if close:
                    out.append(("/" + name, name, ""))
        elif not m[0].startswith(("<!", "<?")):
            if out and not out[-1][1]:
                out[-1] = ("T", "", out[-1][2] + m[0])
            else:
                out.append(("T", "", m[0]))
    return out


def _apart(name: str, named: str, inside: bool = False) -> bool:
    """Whether an element is a menu, footer, notice and so on by its own name or by its class, id and role.

    Outside of an article any word of these tells. Inside, a whole name must: all its words say so, one of them at least
    of ASIDE_WORDS and the others of HOLDER_WORDS; and of an element of the text itself only that it is an advert.
    """
    if name in APART or name == "article" and "comment" in named:
        return True
    if not named or name in ("html", "body", "article", "main"):
        return False
    if not inside:
        return not ASIDE_WORDS.isdisjoint(_WORDS.findall(named))
    asides = ADVERT_WORDS if name in TEXTUAL else ASIDE_WORDS
    words = (set(_WORDS.findall(one)) for one in named.split())
    return any(w & asides and w <= asides | HOLDER_WORDS for w in words)


def roles(stream: list[Token]) -> list[bool]:
    """For each token whether it belongs to the article, by the elements round it."""
    return _roles(stream)[0]


def _roles(stream: list[Token]) -> tuple[list[bool], bool]:
    """The roles, and whether there is an article or main element that tells them.

    What lies in a menu, footer, notice and so on doesn't, up to the end of that element. If there is an article (else a
    main element) outside of these, only its content does.
    """
    kept, home = [], []
    skipping, depth = "", 0
    home_name, home_depth = "", 0
    names = {name for _, name, named in stream if not _apart(name, named)}
    wanted = "article" if "article" in names else "main" if "main" in names else ""
    for symbol, name, named in stream:
        closes = symbol.startswith("/")
        if skipping:
            if name == skipping and name not in VOID:
                depth += -1 if closes else 1
            elif name and (closes and name in ("article", "main", "body", "html") or not closes and name == wanted and not home_depth and skipping not in RAW):
                depth = 0  # it was never closed
            if depth <= 0:
                skipped_last, skipping = skipping, ""
                if name == skipped_last:
                    kept.append(False)
                    home.append(home_depth > 0)
                    continue
            else:
                kept.append(False)
                home.append(home_depth > 0)
                continue
        if name and not closes and name not in VOID and _apart(name, named, home_depth > 0):
            skipping, depth = name, 1
            kept.append(False)
            home.append(home_depth > 0)
            continue
        if name and name == wanted:
            home_depth = max(0, home_depth + (-1 if closes else 1))
        kept.append(True)
        home.append(home_depth > 0)
    return [k and (h or not wanted) for k, h in zip(kept, home, strict=True)], bool(wanted)


def article(stream: list[Token], main: list[bool]) -> str:
    """The marked texts: references decoded, a block's white space one space, blocks joined by newlines."""
    blocks, now = [], []
    for (_, name, content), keep in zip(stream, main, strict=True):
        if name in BREAKS:
            blocks.append(now)
            now = []
        elif not name and keep:
            now.append(content)
    blocks.append(now)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


# Wrappers are nested lists: ["tag", symbol], ["text", constant or None for a slot, texts in the article, texts, pages, texts inside an article or main element],
# ["rep", nodes], ["opt", nodes].


def _key(node: list) -> str:
    return node[1] if node[0] == "tag" else "T" if node[0] == "text" else f"{node[0]}({' '.join(map(_key, node[1]))})"


def _merge(a: list, b: list, page: int = 1) -> list:
    """Two nodes of equal key as one; `page` is 0 within a page."""
    if a[0] == "text":
        return ["text", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], a[4] + b[4] if page else 1, a[5] + b[5]]
    return a if a[0] == "tag" else [a[0], [_merge(x, y, page) for x, y in zip(a[1], b[1], strict=True)]]


#: What a wrapper says of a token: not main text, main text, or a constant of the template where main text may be.
OTHER, MAIN, TEMPLATE = 0, 1, 2


def _verdict(node: list) -> int:
    _, constant, inside, seen, pages, sure = node
    return OTHER if 2 * inside <= seen else TEMPLATE if constant is not None and pages >= CONSTANT and not sure else MAIN


def settled(stream: list[Token], verdicts: list[int]) -> list[bool]:
    """For each token whether it is main text: a constant is, if the block that it is in has other main text, or if it lies between two others."""
    out = [v == MAIN for v in verdicts]
    slots = [at for at, (keep, token) in enumerate(zip(out, stream, strict=True)) if keep and token[2].strip()]
    for at in range(slots[0], slots[-1]) if slots else ():
        out[at] |= verdicts[at] == TEMPLATE
    block, varies = [], False
    for at, (_, name, content) in enumerate(stream):
        if name in BREAKS:
            block, varies = [], False
        elif verdicts[at] == TEMPLATE:
            out[at] |= varies
            block.append(at)
        elif out[at] and content.strip() and not varies:
            varies = True
            for k in block:
                out[k] = True
    return out


def _fold(nodes: list[list], known: set[tuple[str, ...]]) -> list[list]:
    """Equal groups in a row as one repeated group; a group in `known` also if it stands alone."""
    keys, out, i = [_key(x) for x in nodes], [], 0
    while i < len(nodes):
        for d in range(1, LONGEST + 1):
            group, times = keys[i : i + d], 1
            if len(group) < d or group[0] == "T" or group[0].startswith("/"):
                continue
            while keys[i + d * times : i + d * (times + 1)] == group:
                times += 1
            if times > 1 or tuple(group) in known:
                known.add(tuple(group))
                whole = nodes[i : i + d]
                for k in range(1, times):
                    whole = [_merge(a, b, 0) for a, b in zip(whole, nodes[i + d * k : i + d * (k + 1)], strict=True)]
                out.append(["rep", whole])
                i += d * times
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def infer(streams: list[list[Token]]) -> list[list]:
    """The wrapper of the pages of one host."""
    pages = []
    for x in filter(None, streams):
        keeps, told = _roles(x)
        pages.append([["tag", s] if name else ["text", " ".join(content.split()), int(keep), 1, 1, int(keep and told)] for (s, name, content), keep in zip(x, keeps, strict=True)])
    known: set[tuple[str, ...]] = set()
    for p in pages:
        _fold(p, known)
    folded = [f for p in pages if len(f := _fold(p, known)) <= ALIGNED]
    wrapper: list[list] = []
    for k, page in enumerate(folded):
        if not k:
            wrapper = page
            continue
        bare = [x[1] if x[0] == "opt" else [x] for x in wrapper]  # an optional group takes part in the alignment opened
        flat = [(n, x[0] == "opt") for x, nodes in zip(wrapper, bare, strict=True) for n in nodes]
        out: list[list] = []

        def optional(nodes: list[list], out: list[list] = out) -> None:
            if nodes:
                out.append(["opt", nodes])

        for op, i, j, a, b in difflib.SequenceMatcher(None, [_key(n) for n, _ in flat], [_key(n) for n in page], autojunk=False).get_opcodes():
            if op == "equal":
                for (n, was), m in zip(flat[i:j], page[a:b], strict=True):
                    optional([_merge(n, m)]) if was else out.append(_merge(n, m))
            else:
                optional([n for n, _ in flat[i:j]])
                optional(page[a:b])
        wrapper = out
    return wrapper


def match(wrapper: list[list], stream: list[Token]) -> list[bool] | None:
    """For each token whether the wrapper says that it is main text; None if the wrapper doesn't match."""
    verdicts = [OTHER] * len(stream)

    def starts(nodes: list[list], at: int) -> bool:
        return at < len(stream) and (starts(nodes[0][1], at) if nodes[0][0] in ("rep", "opt") else stream[at][0] == _key(nodes[0]))

    def run(nodes: list[list], at: int) -> int:
        for node in nodes:
            kind, value = node[0], node[1]
            if kind == "rep":
                end = run(value, at)
                if end < 0:
                    return -1
                while end > at:
                    at = end
                    if starts(value, at):
                        end = run(value, at)
            elif kind == "opt":
                if starts(value, at) and (end := run(value, at)) >= 0:
                    at = end
            elif at < len(stream) and stream[at][0] == (value if kind == "tag" else "T"):
                if kind == "text":
                    verdicts[at] = _verdict(node)
                at += 1
            else:
                return -1
        return at

    return settled(stream, verdicts) if run(wrapper, 0) == len(stream) else None


def extract(page: str | None, found: list[list[list]]) -> str:
    """The main text of a page by the first of its host's wrappers that matches, else by its elements."""
    stream = tokens(page or "")
    main = next((m for w in found if (m := match(w, stream)) is not None), None)
    text = "" if main is None else article(stream, main)
    return text or article(stream, roles(stream))


def host(url_col: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from columns host and html, the wrapper as JSON; a host with one page has none."""
    order = Window.partitionBy("host").orderBy(F.xxhash64("html"), "html")
    some = pages.where("html IS NOT NULL").select("host", "html").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE)

    def of_host(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        streams = [tokens(p) for p in dict.fromkeys(group["html"])]
        found = infer(streams) if len(streams) > 1 else []
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(found)]})

    return some.groupBy("host").applyInPandas(of_host, "host string, wrapper string").where("wrapper <> '[]'")


class _Held(dict):
    """Wrappers by their JSON, parsed once; a task keeps a few hundred."""

    def __missing__(self, text: str) -> list[list]:
        if len(self) >= 256:
            self.clear()
        self[text] = value = json.loads(text)
        return value


def with_wrappers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `found`, the wrappers of their host in order of their rounds, as JSON texts."""
    of_host = cut(found.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("round", "wrapper"))), lambda x: x["wrapper"]).alias("found")))  # ROUNDS a host
    size = of_host.agg(F.sum(F.octet_length(F.array_join("found", "")) + F.octet_length("host"))).first()[0] or 0
    return rows.join(F.broadcast(of_host) if size < SENT else of_host.hint("shuffle_hash"), "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: `id_col`, `url_col`, text, n_chars (in code points).

    Defined cases: a null or empty html gives an empty text; pages without a host (a null or relative url) share the
    wrappers of the empty host; equal pages count once in a wrapper; pages of more than ALIGNED nodes take no part in an
    alignment but are matched like others; repeated and null ids pass row by row; markup that is never closed ends with
    the element round it; other columns aren't read; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    rows = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), named(html_col).alias("html"), host(url_col).alias("host"))

    def unmatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in batches:
            keep = []
            for page, w in zip(b.column(1), b.column(2), strict=True):
                stream = tokens(page.as_py())
                keep.append(all(match(held[x], stream) is None for x in w.as_py()))
            yield b.select(["host", "html"]).filter(pa.array(keep, pa.bool_()))

    left = rows.where("html IS NOT NULL").select("host", "html")
    found = cut(wrappers(left).withColumn("round", F.lit(1)))
    newest = found
    for k in range(2, ROUNDS + 1):
        if newest.isEmpty():
            break
        asked = with_wrappers(left, newest).where("found IS NOT NULL").select("host", "html", "found")
        left = cut(asked.mapInArrow(unmatched, "host string, html string"), "zstd")  # only these are looked at again
        newest = cut(wrappers(left).withColumn("round", F.lit(k)))
        found = found.unionByName(newest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in batches:
            texts = [extract(page.as_py(), [held[x] for x in w.as_py() or ()]) for page, w in zip(b.column(2), b.column(3), strict=True)]
            n = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), n], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    joined = with_wrappers(rows, found).select("id", "url", "html", "found")
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_text": op10_html_text}
#: SQL has no HTML parser: the query is tested against pages whose text is known.
ORACLE: dict[str, str] = {}
