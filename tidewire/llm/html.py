"""Main text of web pages by union-free wrappers of their hosts.

A page is read as a stream of tokens: containers that open and close, and texts, each with the path of containers
around it. Adjacent equal stretches fold into one repeated group. The streams of a host are aligned two by two: what
both have stays, what one lacks becomes optional, what repeats in either becomes repeated; texts that differ from page
to page are slots, while a text that most pages of a host share is a token of its own. The result is the host's wrapper, a
regular expression without unions, with the number of pages that have each part.

The wrapper then says what is main text. A shared text that is there whenever its container is belongs to the
template. Slots count for as much text as they hold on all pages; links, groups of repeated containers and what is the
same everywhere count against. The container that is worth most is the main one. HTML's own elements for articles
and for what stands around them are believed; words in classes only break ties, and never against most of the text.

Streams are counted before they are aligned and aligned in groups of bounded number and size, so a host with most of
the pages costs as much as its templates are many.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, materialize, materialize_counted, text_or_empty
from .files import release_memory

#: Elements by their role in HTML.
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table figure details dialog fieldset blockquote".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre address hr summary thead tbody tfoot legend center".split()) | CONTAINERS
HIDDEN = frozenset("script style noscript template title iframe svg math object select option textarea button canvas audio video label input".split())
RAW = frozenset("script style iframe textarea".split())
HEAD = frozenset("head title meta link base style script noscript template".split())
#: Hidden elements without blocks inside: where their end tag is missing, a block ends them; these also end where a container begins.
PHRASING, SHORT = frozenset("select option button label title".split()), frozenset("option title".split())
#: Elements whose end tag ends an option.
OPTIONS = frozenset("select datalist optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
AROUND = frozenset("nav footer aside form dialog".split())
#: Flags before a container's key in a path: stands around or is main by its element, or by the words of its class.
AROUND_TAG, MAIN_TAG, AROUND_WORD, MAIN_WORD = "-+~*"
#: Words in a class, id or role that hint at what stands around the main text.
MARKS = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail footer foot masthead topbar toolbar cookie cookies consent notice notices gdpr alert popup modal overlay dialog newsletter subscribe subscription signup login comment comments reply replies disqus respond share sharing social related recommended widget search pagination pager tags toc contentinfo complementary".split())
MAIN = frozenset("article main".split())
MAIN_MARKS = frozenset("article main content story post entry".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _role(name: str, attributes: str) -> tuple[str, str]:
    """(key, flag) of a container. The key has its name and the words of class, id and role."""
    words: set[str] = set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            words.update(_WORD.findall((m[2] or m[3] or m[4] or "").lower()))
    if name in AROUND:
        flag = AROUND_TAG
    elif name in MAIN:
        flag = MAIN_TAG
    elif words & MARKS and name not in ("html", "body"):
        flag = AROUND_WORD
    else:
        flag = MAIN_WORD if words & MAIN_MARKS else ""
    return name + "".join(f".{w}" for w in sorted(words)), flag


def blocks(page: str) -> tuple[list[tuple[str, str, int]], list[str]]:
    """The visible blocks of a page, (slot, text, characters in links) in order, and its token stream."""
    stack: list[tuple[str, str, str]] = []  # name, key, flag
    out: list[tuple[str, str, int]] = []
    stream: list[str] = []
    text: list[str] = []
    linked, in_link, in_head = 0, False, False
    hidden, within = 0, 0  # open elements of the hidden one's name, and containers open inside it
    hidden_name, tag, path = "", "text", ""

    def flush() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            text.clear()
            if words:
                slot = f"#{path}>{tag}"
                out.append((slot, " ".join(words), linked))
                stream.append(slot)
        linked = 0

    def locate() -> str:
        # A header inside the main container belongs to it; one outside stands around.
        inside = False
        parts = []
        for name, key, flag in stack:
            parts.append((AROUND_TAG if name == "header" and not inside else flag) + key)
            inside = inside or flag in (MAIN_TAG, MAIN_WORD)
        return ">".join(parts)

    def ends_hidden(name: str, close: str, attributes: str) -> bool:
        """Whether what is hidden is over before this tag; an element without an end tag ends with its container."""
        nonlocal hidden, within
        if name == hidden_name:
            if close:
                hidden -= 1
            elif name != "option" and not attributes.rstrip().endswith("/"):
                hidden += 1
            return False
        if name in CONTAINERS:
            if not within and (close or hidden_name in SHORT):
                return True
            within += -1 if close else 1
            return False
        if hidden_name == "option" and close and name in OPTIONS or hidden_name == "title" and name in ("head", "body"):
            return True
        return not within and name in BREAKS and hidden_name in PHRASING

    def skip_raw(name: str) -> int:
        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
        return end.end() if end else len(page)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not hidden:
            if in_head and not page[at : m.start()].isspace():
                in_head = False
            if not in_head:
                text.append(html.unescape(page[at : m.start()]))
                linked += len(text[-1].strip()) if in_link else 0
        if m.start() < at:
            continue
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if hidden:
            if name in RAW and not close:  # nothing inside is markup
                at = skip_raw(name)
                continue
            if not ends_hidden(name, close, attributes):
                continue
            hidden = 0
        if name == "head":
            in_head = not close
            continue
        if in_head and (name not in HEAD or close and name in CONTAINERS):
            in_head = False
        if name in HIDDEN:
            if close or name in VOID or attributes.rstrip().endswith("/"):
                continue
            if name in RAW:
                at = skip_raw(name)
                continue
            hidden, within, hidden_name = 1, 0, name
            continue
        if name in BREAKS:
            flush()
            if name in CONTAINERS:
                if close:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            for x in reversed(stack[k:]):
                                stream.append("</" + x[1])
                            del stack[k:]
                            break
                elif name not in ("html", "body") or all(x[0] != name for x in stack):
                    key, flag = _role(name, attributes)
                    stack.append((name, key, flag))
                    stream.append("<" + key)
                path, tag = locate(), "text"
            else:
                tag = "text" if close else name
        elif name == "br":
            text.append(" ")
        elif name == "a":
            in_link = not close
    if at < len(page) and not hidden:
        text.append(html.unescape(page[at:]))
    flush()
    return out, stream


#: A wrapper's part: (tokens, pages that lack it, repeated). It is optional if any page lacks it.
Part = tuple[tuple[str, ...], int, bool]


def fold(parts: list[Part]) -> list[Part]:
    """Joins adjacent equal stretches of any length into one repeated part, until nothing changes."""
    period, codes = 1, None
    while period <= len(parts) // 2:
        if codes is None:
            names: dict[tuple[str, ...], int] = {}
            codes = np.array([names.setdefault(p[0], len(names)) for p in parts])
        same = codes[:-period] == codes[period:]
        if np.count_nonzero(same) < period:
            period += 1
            continue
        # Runs of places that equal those one period on; a run as long as the period is a repetition.
        ends = np.append(np.flatnonzero(~same), len(same))
        runs = np.diff(np.concatenate([[-1], ends])) - 1
        long = np.flatnonzero(runs >= period)
        if not len(long):
            period += 1
            continue
        out: list[Part] = []
        at = 0
        for first, n in zip((ends[long] - runs[long]).tolist(), runs[long].tolist(), strict=True):
            if first < at:
                continue
            times = n // period + 1
            run = parts[first : first + times * period]
            out += parts[at:first]
            out.append((tuple(t for p in run[:period] for t in p[0]), min(p[1] for p in run), True))
            at = first + times * period
        parts = out + parts[at:]
        period, codes = 1, None
    return parts


def align(a: list[Part], b: list[Part], pages_a: int = 1, pages_b: int = 1) -> list[Part]:
    """The least wrapper of both: common parts stay, others are optional; repeated in one is repeated."""
    out: list[Part] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, [p[0] for p in a], [p[0] for p in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(x[0], x[1] + y[1], x[2] or y[2]) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [(p[0], p[1] + pages_b, p[2]) for p in a[i:j]] + [(p[0], p[1] + pages_a, p[2]) for p in b[k:m]]
    return fold(out)


def expression(wrapper: list[Part]) -> str:
    """The wrapper in the usual notation."""
    marks = {(True, True): "*", (False, True): "+", (True, False): "?"}
    return " ".join(f"({x}){marks[p[1] > 0, p[2]]}" if p[2] or p[1] else x for p in wrapper for x in [" ".join(p[0])])


#: A text of the template is left out of the main text if all such texts have at most this share of its characters.
TEMPLATE_SHARE = 0.25
#: Words in classes don't outweigh this share of the text.
MOST_TEXT = 0.9


def labels(wrapper: list[Part], chars: dict[str, tuple[int, int, bool]], pages: int = 1) -> tuple[frozenset[str], frozenset[str]]:
    """The slots of a wrapper that hold main text, and the shared texts among them that belong to the template.

    ``chars`` has for each slot its characters on all pages, those in links, and whether its text never differs.
    """
    paths: dict[str, list[str]] = {}
    single, shared = set(), Counter()
    within: dict[str, int] = {}
    held = [0]  # pages that have the container around the current token
    for tokens, lacking, repeated in wrapper:
        seen = pages - lacking
        records = repeated and any(t[0] == "<" for t in tokens)
        for t in tokens:
            if t[0] == "<" and t[1] != "/":
                held.append(seen)
            elif t[0] == "<":
                held = held[:-1] or [0]
            else:
                slot = "#" + t.partition("#")[2]
                paths[slot] = slot[1:].split(">")
                if not records:
                    single.add(slot)
                if t[0] == "=":
                    shared[t] += seen if not repeated else 0
                    within[t] = max(within.get(t, 0), held[-1])
    weight = {s: chars.get(s, (1, 0, False))[0] for s in paths}
    total = lambda of: sum(weight[s] for s in of)

    def flags(slot: str) -> str:
        return "".join(x[:1] if x[:1] in (AROUND_TAG, MAIN_TAG, AROUND_WORD, MAIN_WORD) else "." for x in paths[slot])

    open_ = [s for s in paths if AROUND_TAG not in flags(s)]
    is_main = lambda s: MAIN_TAG in flags(s) or MAIN_WORD in flags(s)
    free = [s for s in open_ if AROUND_WORD not in flags(s)]
    if not any(map(is_main, free)):
        # A word around an article ("with-sidebar") may be there for something else than the article.
        inside = [s for s in open_ if MAIN_TAG in flags(s) and AROUND_WORD not in flags(s)[flags(s).index(MAIN_TAG) :]]
        if total(inside) > total(free):
            free = inside
        elif total(free) < (1 - MOST_TEXT) * total(open_):
            free = open_
    main = [s for s in free if MAIN_TAG in flags(s)] or [s for s in free if MAIN_WORD in flags(s)]
    if not main:
        varying = [s for s in free if not chars.get(s, (1, 0, False))[2]] or free
        records = [s for s in varying if s not in single]
        if 2 * total(records) > total(varying):  # what repeats is all there is
            records = []
        worth: Counter[str] = Counter()
        for s in free:
            n, linked, _ = chars.get(s, (1, 0, False))
            good = s in varying and s not in records and 2 * linked <= n
            for k in range(len(paths[s])):
                worth[">".join(paths[s][:k])] += n if good else -n
        best = max(worth, key=lambda p: (worth[p], len(p)), default="")
        main = [s for s in free if not best or ">".join(paths[s]).startswith(best + ">")]
        if worth[best] > 0:
            main = [s for s in main if s in varying and s not in records]
    template = frozenset(t for t, n in shared.items() if n >= within[t] and "#" + t.partition("#")[2] in main)
    text_of = Counter()
    for t in template:  # about as much text as its length says on each page that has it
        text_of[True] += int(t[1:].partition(":")[0]) * shared[t]
    if text_of[True] > TEMPLATE_SHARE * total(main):
        template = frozenset()  # the pages are copies of each other
    return frozenset(main), template


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _literal(slot: str, text: str) -> str:
    """A shared text as a token: its length, a hash, and the slot it would be."""
    return f"={len(text)}:{hashlib.blake2b(text.encode('utf-8', 'replace'), digest_size=8).hexdigest()}{slot}"


def _stream_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, streams, texts, slots = [], [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found, stream = blocks(page)
            own: dict[str, list] = {}
            for slot, text, linked in found:
                x = own.setdefault(slot, [0, 0, hashlib.blake2b(digest_size=8)])
                x[0] += len(text)
                x[1] += min(linked, len(text))
                x[2].update(text.encode("utf-8", "replace") + b"\n")
            hosts.append(host_of(url))
            streams.append(stream)
            texts.append([_literal(slot, text) for slot, text, _ in found])
            slots.append([{"slot": s, "chars": x[0], "linked": x[1], "text": x[2].hexdigest()} for s, x in own.items()])
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("slot", pa.string()), ("chars", pa.int64()), ("linked", pa.int64()), ("text", pa.string())]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((hosts, streams, texts, slots), kinds, strict=True)], ["host", "stream", "texts", "slots"])
        release_memory()


def _folder(table: Broadcast | None):
    """Folds streams; the shared texts of a host come from ``table``, or where it is None from the rows."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            hosts = batch.column("host").to_pylist()
            shared = [table.value.get(h, ()) for h in hosts] if table else batch.column("shared").to_pylist()
            for stream, texts, own in zip(batch.column("stream").to_pylist(), batch.column("texts").to_pylist(), shared, strict=True):
                known, at, parts = frozenset(own or ()), iter(texts), []
                for t in stream:
                    literal = next(at) if t[0] == "#" else None
                    parts.append(((literal if literal in known else t,), 0, False))
                out.append(json.dumps(fold(parts), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "stream"])
            release_memory()

    return folded


def _parts(text: str) -> list[Part]:
    return [(tuple(t), n, r) for t, n, r in json.loads(text)]


def _align_group(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper: list[Part] = []
    pages = 0
    for text, n in sorted(zip(rows["stream"], rows["pages"].tolist(), strict=True)):
        wrapper = align(wrapper, _parts(text), pages, n) if pages else _parts(text)
        pages += n
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "stream": [json.dumps(wrapper, ensure_ascii=False)], "pages": [pages]})


#: Streams that are aligned in one task: so many, or fewer if they are long.
FAN_IN, FAN_CHARS = 64, 1_000_000
#: A text is shared from this many pages of a host on, if half of its pages have it; so shared texts are no more than two pages hold.
SHARED_FROM = 3


#: Parts of a host's pages where its shared texts are joined to them.
SALTS = 64
#: Labels or shared texts of all hosts go to each worker if they are at most this long in all; beyond it, they are joined by host.
BROADCAST_CHARS = 4_000_000


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, stream, pages, slots): each host's wrapper as JSON, its number of pages, and of each slot the characters, those in links, and whether the text never differs."""
    read = pages.select(col(url).cast("string").alias("url"), text_or_empty(page).alias("html"))
    rows = materialize(read.mapInArrow(_stream_rows, "host string, stream array<string>, texts array<string>, slots array<struct<slot:string,chars:long,linked:long,text:string>>"), "streams")
    of_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    often = rows.select("host", F.explode(F.array_distinct("texts")).alias("t")).groupBy("host", "t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED_FROM)
    shared = often.join(of_host, "host").where("2 * n >= all").groupBy("host").agg(F.collect_list("t").alias("shared"))
    shared, seen = materialize_counted(shared, "shared", chars=F.length("host") + F.length(F.array_join("shared", "")))
    own = rows.select("host", "stream", "texts")
    if seen.chars <= BROADCAST_CHARS:
        table = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.shared) for r in shared.collect()})
    else:  # a host with most of the pages is dealt over several tasks
        table, salt = None, F.pmod(F.xxhash64("stream"), F.lit(SALTS)).alias("salt")
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        own = own.select("*", salt).join(salted, ["host", "salt"], "left").select("host", "stream", "texts", "shared")
    streams = own.mapInArrow(_folder(table), "host string, stream string")
    streams = streams.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages"))
    while True:
        streams = materialize(streams, "streams")
        n = streams.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("stream")).alias("chars"))
        if (n.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        # At least two in a group on average, so that each round at most halves a host's streams.
        groups = F.least(F.greatest(F.ceil(F.col("n") / FAN_IN), F.ceil(F.col("chars") / FAN_CHARS)), F.ceil(F.col("n") / 2))
        dealt = streams.join(n.withColumn("groups", groups), "host").withColumn("g", F.pmod(F.xxhash64("stream"), F.col("groups")))
        streams = dealt.select("host", "stream", "pages", "g").groupBy("host", "g").applyInPandas(_align_group, "host string, stream string, pages long")
    texts = rows.select("host", F.explode("slots").alias("s")).groupBy("host", F.col("s.slot").alias("slot"))
    texts = texts.agg(F.sum("s.chars").alias("chars"), F.sum("s.linked").alias("linked"), ((F.min("s.text") == F.max("s.text")) & (F.count(F.lit(1)) >= SHARED_FROM)).alias("same"))
    slots = texts.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "linked", "same")).alias("slots"))  # slots of one wrapper
    return streams.join(slots, "host", "left").select("host", "stream", "pages", "slots")


def _own_labels(found: list[tuple[str, str, int]], stream: list[str]) -> frozenset[str]:
    chars: dict[str, list[int]] = {}
    for slot, text, linked in found:
        x = chars.setdefault(slot, [0, 0])
        x[0] += len(text)
        x[1] += min(linked, len(text))
    return labels(fold([((t,), 0, False) for t in stream]), {s: (x[0], x[1], False) for s, x in chars.items()})[0]


def extracted(page: str, main: frozenset[str], template: frozenset[str]) -> str:
    """The blocks of ``page`` in main slots that are no text of the template, a line each."""
    found, stream = blocks(page)
    text = [t for slot, t, _ in found if slot in main and not (template and _literal(slot, t) in template)]
    if not text and found:  # a page that the wrapper doesn't fit: its own stream is its wrapper
        own = _own_labels(found, stream)
        text = [t for slot, t, _ in found if slot in own]
    return "\n".join(text)


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for stream, pages, slots in zip(*(batch.column(c).to_pylist() for c in ("stream", "pages", "slots")), strict=True):
            main, template = labels(_parts(stream), {x["slot"]: (x["chars"], x["linked"], x["same"]) for x in slots or ()}, pages)
            out.append(json.dumps([sorted(main), sorted(template)], ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "labels"])


def extract_main_text(pages: DataFrame, wrappers: DataFrame | None = None, url: str = "url", page: str = "html") -> tuple[DataFrame, dict[str, str]]:
    """Adds text and n_chars under free names: the blocks of the host's main slots, joined by line ends.

    Null pages are empty and give an empty text. Pages without a host, or with a url that is null or none, share the
    empty host. Equal rows give equal results, and each counts as a page of its host; an empty table stays empty;
    other columns pass through whatever their names, the page's too.
    """
    names = {k: free_name(pages, k) for k in ("text", "n_chars")}
    wrappers = infer_wrappers(pages, url, page) if wrappers is None else wrappers
    labelled, seen = materialize_counted(wrappers.mapInArrow(_label_rows, "host string, labels string"), "labels", chars=F.length("host") + F.length("labels"))
    schema = pages.withColumn(names["text"], F.lit("")).withColumn(names["n_chars"], F.lit(0).cast("long")).schema
    n = len(pages.columns)
    at_url, at_page = pages.columns.index(url), pages.columns.index(page)
    small = seen.chars <= BROADCAST_CHARS
    table = pages.sparkSession.sparkContext.broadcast({r.host: r.labels for r in labelled.collect()}) if small else None

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        for batch in batches:
            hosts = list(map(host_of, batch.column(at_url).cast(pa.string()).to_pylist()))
            given = [table.value.get(h) for h in hosts] if small else batch.column(n).to_pylist()
            texts = []
            for h, p, x in zip(hosts, batch.column(at_page).cast(pa.string()).to_pylist(), given, strict=True):
                if h not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[h] = tuple(map(frozenset, json.loads(x or "[[], []]")))
                texts.append(extracted(p or "", *known[h]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[x.name for x in schema.fields])
            release_memory()

    own = pages.select(*[col(c) for c in pages.columns])
    if not small:
        host, key, given = (free_name(pages, x) for x in ("_host", "_wh", "_labels"))
        of_host = F.pandas_udf(lambda s: s.map(host_of), "string")
        side = labelled.select(F.col("host").alias(key), F.col("labels").alias(given))
        keyed = own.withColumn(host, of_host(F.coalesce(col(url).cast("string"), F.lit(""))))
        own = keyed.join(side, col(host) == col(key), "left").select(*[col(c) for c in pages.columns], given)
    return own.mapInArrow(extract, schema), names
