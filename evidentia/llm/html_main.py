"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its opening and closing tags, named by their path, and
its runs of text. Tokens of one host with the same occurrence vector (how
often in which page) form an equivalence class. Classes of at least two tokens
that occur once a page, on SUPPORT pages and on SHARE of the host's, are
valid; they nest by their paths into the host's template. Texts on FIXED of
the pages belong to the template, too. What lies between the tags of a valid
class's container is a slot, and the slots nest as the classes do.

A page's main text is the content of one slot: from the outermost slot, the
way goes into the inner slot that holds most of what the template doesn't fix
and no link holds, as long as that is SLOT of the outer one's; below that, into
the only one with a heading. Names serve where this leaves a choice (an article
or main element comes before others, and ends the way) and to leave out parts
inside the slot, such as forms, adverts and comments.

Occurrence vectors are compared by a 64-bit signature that adds up in any
order, so a host of any size is summed in partial aggregates. What meets in
one task are tokens on SHARE of a host's pages: at most 1 / SHARE times the
tokens of an average page, however many pages the host has.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ship, written

SUPPORT = 3
#: Least share of a host's pages with a token of a valid class, and with a text of the template.
SHARE, FIXED = 0.1, 0.1
#: Least share of a slot's text in the inner slot to go into.
SLOT = 0.6
#: Templates up to this size in total are sent to every executor; more are joined by host.
SENT_BYTES = 16 << 20

# Elements and names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OTHER = frozenset("aside button canvas dialog footer form head iframe input math menu nav noscript option script select style svg template textarea title".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice overlay popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE = ("article", "main")
#: Elements that make slots; those without a meaning of their own are told apart by their number among siblings.
GENERIC = frozenset("center div section table tbody td tr".split())
CONTAINERS = GENERIC | frozenset(ARTICLE) | {"body"}
HEADINGS = ("h1", "h2")
#: Names that an article element may have and still be something else; the others only say where it stands.
OTHER_ARTICLES = frozenset("ad ads advert adverts advertisement comment comments promo promotion related replies reply sponsor sponsored".split())
ROLES = frozenset("banner navigation contentinfo complementary search form alert dialog menu toolbar".split())

#: Elements nested deeper than this share one path; tags whose quotes lead nowhere after which quotes no longer count.
DEEP, MISLED = 64, 16
#: Parts of a class name that speak of the page around; the rest of the name is no name of the element.
ABOUT = frozenset(["has", "have", "no", "not", "with", "without", "is", "hide", "show", "single"])

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
Run = tuple[str, bool, str]


def _excluded(name: str, value: str, article: bool) -> int:
    """By a class or id: 2 an element other than main text, 1 one unless an article lies inside, 0 none.

    A whole name says so; a name of several words says less, and one about the
    page (has-sidebar) nothing. Page and body are never excluded.
    """
    found = 0
    if name in ("html", "body"):
        return 0
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if not words or words[0] in ABOUT or (OTHER_ARTICLES if article else OTHER_NAMES).isdisjoint(words):
            continue
        found = max(found, 2 if len(words) == 1 or article else 1)
    return found


def _named(name: str, attributes: str) -> tuple[str, int, bool]:
    """Path step of an element; how far it is something other than main text (as _excluded); whether it is an article."""
    step, other, article = name, 2 * (name in OTHER), name in ARTICLE
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            key = key.lower()
            step += {"class": ".", "id": "#", "role": "@"}[key] + "_".join(value.split())
            if key == "role":
                other, article = max(other, 2 * (value in ROLES)), article or value == "main"
            else:
                other = max(other, _excluded(name, value, article))
    return step, other, article


def _markup(text: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, tag) of all markup, None for comments and declarations, in one pass.

    A quote that hides every later > is no quote: its tag ends at the next >.
    The one who reads raw text may send the place to go on from.
    """
    last, at, misled = text.rfind(">"), text.find("<"), 0
    while 0 <= at:
        to = at + 1
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            to = len(text) if end < 0 else end + 3
            yield at, to, None
        elif at < last:
            if text[at + 1] in "!?":
                to = text.find(">", at) + 1
                yield at, to, None
            elif text[at + 1].isalpha() or text[at + 1] == "/":
                m = _TAG.match(text, at) if misled < MISLED else None
                if not m and (m := _PLAIN_TAG.match(text, at)):
                    misled += 1
                if m:
                    to = m.end()
                    to = (yield at, to, m) or to
        at = text.find("<", to)


def parse(page: str | None) -> tuple[list[str], list[Run], list[str]]:
    """Tag tokens ("<path", ">path"), runs of text (path, whether other than main text, text), article paths.

    Unclosed, stray and crossing tags are taken as browsers take them, roughly;
    a block boundary is a run with a line break as text. Time and memory grow
    with the page: elements nested deeper than DEEP share a path.
    """
    tags: list[str] = []
    raw: list[tuple[int, str]] = []
    told: list[tuple[str, int]] = []
    #: Of every element: its parent, its path, and how far it is something other than main text.
    around, paths, others = [0], [""], [0]
    stack: list[tuple[str, int, dict[str, int]]] = [("", 0, {})]
    opened: dict[str, int] = {}
    lifted = 0  # so many open elements, the outermost, hold an article
    text = page or ""

    def close(depth: int) -> None:
        nonlocal lifted
        while len(stack) > depth:
            name, i, _ = stack.pop()
            opened[name] -= 1
            tags.append(">" + paths[i])
        lifted = min(lifted, len(stack))

    def innermost(name: str) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0) if opened.get(name) else 0

    at, markup = 0, _markup(text)
    found = next(markup, None)
    while found:
        start, end, m = found
        if start > at:
            raw.append((stack[-1][1], text[at:start]))
        at, resume = end, None
        if m:
            name = m[2].lower()
            if name not in INLINE:
                raw.append((stack[-1][1], "\n"))
            if m[1]:
                if depth := innermost(name):
                    close(depth)
            else:
                if name in CLOSES_P:
                    depth = innermost("p")
                    if depth and all(e[0] in INLINE or e[0] == "p" for e in stack[depth:]):
                        close(depth)
                elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
                    close(len(stack) - 1)
                step, other, article = _named(name, m[3])
                up = stack[-1][1]
                if len(stack) > DEEP:
                    path = paths[up] if len(stack) > DEEP + 1 else f"{paths[up]}/~"
                else:
                    if name in GENERIC:
                        number = stack[-1][2][step] = stack[-1][2].get(step, 0) + 1
                        step += f":{number}" if number > 1 else ""
                    path = f"{paths[up]}/{step}"
                if name == "header" and not article and not any(opened.get(x) for x in ARTICLE):
                    other = 2
                around.append(up)
                paths.append(path)
                others.append(other)
                i = len(paths) - 1
                tags.append("<" + path)
                if article and other < 2:
                    told.append((path, i))
                    for e in stack[lifted:]:  # what holds an article isn't excluded by a name of several words
                        others[e[1]] &= 2
                    others[i] &= 2
                    lifted = len(stack)
                if name in VOID or m[3].endswith("/"):
                    tags.append(">" + path)
                else:
                    stack.append((name, i, {}))
                    opened[name] = opened.get(name, 0) + 1
                    if name in RAW:
                        shut = re.compile(f"</{re.escape(name)}", re.I).search(text, at)
                        stop = shut.start() if shut else len(text)
                        raw.append((i, text[at:stop]))
                        past = text.find(">", stop) if shut else -1
                        at = resume = past + 1 if past >= 0 else len(text)
                        close(len(stack) - 1)
        try:
            found = markup.send(resume)
        except StopIteration:
            found = None
    if at < len(text):
        raw.append((stack[-1][1], text[at:]))
    close(1)
    for i in range(1, len(others)):
        others[i] = 1 if others[i] or others[around[i]] else 0
    return tags, [(paths[i], others[i] == 1, t) for i, t in raw], [p for p, i in told if not others[i]]


def _clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[tuple[str, str], list[int]] = {}

    def rows() -> pd.DataFrame:
        keys = list(seen)
        f = pd.DataFrame({"host": pd.Series([k[0] for k in keys], dtype=object), "token": pd.Series([k[1] for k in keys], dtype=object)})
        return f.assign(pages=[v[0] for v in seen.values()], times=[v[1] for v in seen.values()], vector=[v[2] for v in seen.values()])

    for b in batches:
        for page_id, host, page in zip(b["page_id"], b["host"], b["html"]):
            tags, runs, _ = parse(page)
            count: dict[str, int] = {}
            for t in tags:
                count[t] = count.get(t, 0) + 1
            for path, _, text in runs:
                if s := _clean(text):
                    t = f"={_hash(path, s)}"
                    count[t] = count.get(t, 0) + 1
            marks = [_hash(page_id, n) for n in range(max(count.values(), default=0) + 1)] if len(count) else []
            for t, n in count.items():
                v = seen.setdefault((host, t), [0, 0, 0])
                v[0] += 1
                v[1] += n
                v[2] ^= marks[n]
        if len(seen) > 200_000:
            yield rows()
            seen.clear()
    yield rows()


def _outer(path: str, among: dict[str, int] | frozenset[str]) -> str | None:
    """The nearest enclosing element of path that is in among."""
    while path := path.rpartition("/")[0]:
        if path in among:
            return path
    return None


def _template(pdf: pd.DataFrame) -> pd.DataFrame:
    """The template of one host: its valid classes, nested, with their slots, and its texts."""
    host, total = pdf["host"].iloc[0], int(pdf["host_pages"].iloc[0])
    classes: dict[tuple[int, int], list[str]] = {}
    fixed = []
    for t, p, n, v in sorted(zip(pdf["token"], pdf["pages"], pdf["times"], pdf["vector"])):
        if t[0] == "=" and p >= FIXED * total:
            fixed.append(int(t[1:]))
        if n == p:
            classes.setdefault((int(p), int(v)), []).append(t)
    order = sorted((k for k, c in classes.items() if len(c) >= 2), key=lambda k: (-k[0], min(len(t) for t in classes[k]), k[1]))
    opened = {t[1:]: i for i, k in enumerate(order) for t in classes[k] if t[0] == "<"}
    nested = []
    for i, k in enumerate(order):
        inside = {opened.get(_outer(t[1:], opened)) for t in classes[k] if t[0] != "="} - {i}
        slots = [t[1:] for t in classes[k] if t[0] == "<" and _name(t[1:]) in CONTAINERS]
        nested.append({"pages": k[0], "around": min((x for x in inside if x is not None), default=None), "slots": slots})
    return pd.DataFrame({"host": pd.Series([host], dtype=object), "template": pd.Series([json.dumps({"classes": nested, "fixed": fixed})], dtype=object)})


def _name(path: str) -> str:
    return re.split(r"[.#@:]", path.rpartition("/")[2], maxsplit=1)[0]


def hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) as JSON, of hosts with at least SUPPORT pages; pages as from hosts()."""
    sizes = written(pages.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= SUPPORT))
    tokens = pages.select("page_id", "host", "html").mapInPandas(_tokens, "host string, token string, pages long, times long, vector long")
    tokens = tokens.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.bit_xor("vector").alias("vector")).where(F.col("pages") >= SUPPORT)
    tokens = written(tokens.join(sizes, "host").where(F.col("pages") >= SHARE * F.col("host_pages")), texts=True)
    return tokens.groupBy("host").applyInPandas(_template, "host string, template string")


Slots = dict[str, str | None]


@lru_cache(maxsize=4096)
def _known(template: str | None) -> tuple[Slots | None, frozenset[int]]:
    """Slots of a template, each with the one around it, and the texts that the template fixes."""
    if not template:
        return None, frozenset()
    t = json.loads(template)
    within = {path: c["around"] for c in t["classes"] for path in c["slots"]}
    number = {path: i for i, c in enumerate(t["classes"]) for path in c["slots"]}

    def outer(path: str) -> str | None:
        # a slot of the same class or of one that the class nests in
        up = _outer(path, number)
        while up is not None and number[up] != number[path]:
            c = within[path]
            while c is not None and c != number[up]:
                c = t["classes"][c]["around"]
            if c is not None:
                break
            up = _outer(up, number)
        return up

    return {path: outer(path) for path in number}, frozenset(t["fixed"])


def _meant(slot: str | None) -> bool:
    return slot is not None and (_name(slot) in ARTICLE or "@main" in slot.rpartition("/")[2])


def main_slot(runs: list[Run], slots: Slots, fixed: frozenset[int], names: bool = True) -> str | None:
    """The slot that holds a page's main text, None for the page as a whole.

    names=False leaves elements and roles out of the choice.
    """
    mass: dict[str | None, int] = {}
    headed: set[str | None] = set()
    over: set[str | None] = set()  # slots with a heading at any depth
    chains: dict[str, tuple[list[str | None], bool, bool]] = {}
    for path, other, text in runs:
        if other or text == "\n" or not (s := _clean(text)) or _hash(path, s) in fixed:
            continue
        if path not in chains:
            own = path if path in slots else _outer(path, slots)
            up: list[str | None] = [own]
            while up[-1] is not None:
                up.append(slots[up[-1]])
            inside = path[len(own or "") :].split("/")
            chains[path] = up, any(step.startswith(HEADINGS) for step in inside), any(re.split(r"[.#@]", step, maxsplit=1)[0] == "a" for step in inside)
        up, heading, link = chains[path]
        for slot in up:
            mass[slot] = mass.get(slot, 0) + (0 if link else len(s))
        if heading:
            headed.add(up[0])
            over.update(up)
    at: str | None = None
    while at not in headed and not (names and _meant(at)):
        inner = [p for p in mass if p is not None and slots[p] == at]
        best = max(inner, key=lambda p: (mass[p], p), default=None)
        if best is None or not mass[best]:
            break
        if mass[best] < SLOT * mass[at]:
            tied = [p for p in inner if names and _meant(p)] or [p for p in inner if p in over]
            if len(tied) != 1:
                break
            best = tied[0]
        at = best
    if names and not _meant(at):
        below = [p for p in mass if _meant(p) and (at is None or p.startswith(at + "/"))]
        if below and (at is None or _name(at) == "body" or at not in headed):
            return min(below, key=lambda p: (p.count("/"), -mass[p], p))
    return at


def main_text(page: str | None, template: str | None = None, names: bool = True) -> str:
    """Main text of a page under a template of its host, or alone; names as for main_slot.

    Alone, or where the page has none of the template's slots, the outermost
    article or main element is the text, or else the whole page.
    """
    slots, fixed = _known(template)
    _, runs, articles = parse(page)
    main = main_slot(runs, slots, fixed, names) if slots else None
    if main is None and names:
        main = min(articles, key=len, default=None)
    out = []
    for path, other, text in runs:
        if other or (main is not None and path != main and not path.startswith(main + "/")):
            continue
        if fixed and (main is None or _name(main) == "body") and text != "\n" and (s := _clean(text)) and _hash(path, s) in fixed:
            continue
        out.append(text if text == "\n" else entities.unescape(text))
    return _SPACE.sub(" ", "".join(out)).strip()


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [main_text(h, None if t is None or t != t else t) for h, t in zip(b["html"], b["template"])]
        f = pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": pd.Series(texts, dtype=object)})
        yield f.assign(n_chars=[len(t) for t in texts])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null and empty pages, and pages without main text, have an empty text.
    Hosts with fewer than SUPPORT pages, and urls without a host when they are
    as few, have no template; their pages are read alone. Inside the main slot
    no text counts as template, however often it recurs, unless that slot is the
    whole body. Repeated rows and null
    page_ids have a row each; other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = hosts(pages)
    known = written(templates(rows))
    size = known.agg(F.sum(F.length("template") + F.length("host") + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= SENT_BYTES else known, "host", "left")
    return joined.select("page_id", "url", "html", "template").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
