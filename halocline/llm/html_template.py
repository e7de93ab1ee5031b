"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its structural tags, each named by its path of open elements, and its runs of text.
Tokens of one host that occur equally often in every page share an occurrence vector and form an
equivalence class; vectors are compared by sums of hashes over all pages of the host, so that a host of
any size is combined map-side. Classes that a large part of the host's pages has, and whose paths lie
inside one another, nest into the host's template. Texts of the class of the page frame are part of the
template, where chance would not make as many texts constant; the other texts fill its slots. The slot with
the most filling that lies in no menu, header, footer, advert, form or comments is the article, together
with the slots around and below it that the page frame does not share, and its blocks are the result.
"""

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import functions as F

from halocline.llm.common import stored

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br input label meta link base area col embed param source track".split()
)
TEXT_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "hgroup address hr details summary center".split()
)
CLOSED_BY_BLOCK = TEXT_BLOCKS | frozenset("div section article aside nav header footer main form fieldset".split())
VOID = frozenset("hr".split())
SKIPPED = frozenset(
    "nav header footer aside form script style noscript template iframe button select option textarea dialog menu "
    "svg head title object canvas".split()
)
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond replies share sharing "
    "social related recommended widget toolbar pagination pager login signin signup search skip copyright".split()
)
#: Words that say nothing in a name: a name marks an element if all its words are marked or plain.
PLAIN = frozenset(
    "a area bar block bottom box btn button buttons col column container content cont div element form foot group head holder "
    "icon icons inline inner item items left line link links list main outer page pane panel post right row section site "
    "slot small spot sticky text the top unit wrap wrapper zone".split()
)
#: Names and roles, and these elements, are weak evidence: they may stand around the article.
WEAK = frozenset("form".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())
MAIN = ("article", "main")
#: Paths of the page itself.
FRAME = r"^(?:html[^/]*/?)?(?:body[^/]*)?$"
#: Path of the outermost article or main element.
CONTAINER = r"^((?:.*?/)?(?:" + "|".join(MAIN) + r")(?:\.[^/]*)?)(?:/|$)"
#: A class is part of the template if so large a part of the host's pages has it.
SUPPORT = 0.5
#: Number of constant texts that chance may give a host, for its constant texts to count as template.
CHANCE = 0.01

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<empty>template|iframe|svg)\b[^>]*/>"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(value):
    """Whether one of the names in a class or id says menu, advert, comment or the like, and nothing else."""
    for name in value.split():
        parts = {p.lower() for p in PART.findall(name)}
        if not parts.isdisjoint(MARKED) and parts <= MARKED | PLAIN:
            return True
    return False


def _label(name, attributes, lifted=False, own=False):
    """Name of an element in paths: tag, its marks, and a leading ``-`` if its text does not count.

    ``lifted`` leaves weak evidence out. ``own`` is for the header of an article, which holds its title.
    """
    lifted = lifted or own
    strong = name in SKIPPED and not (lifted and name in WEAK) and not own
    if not attributes or "=" not in attributes:
        return ("-" + name if strong else name)
    marks, skipped = [], False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "role":
            skipped |= value.lower() in ROLES
        else:
            skipped |= _marked(value)
            if key.lower() == "class":
                marks += sorted(value.split())
    label = ".".join([name, *marks]).replace("/", "_")
    skipped = strong or skipped and not lifted
    return "-" + label if skipped and name not in ("html", "body") else label


def blocks(html):
    """(paths of the structural tags, [(container path, skipped, text)]) of a page.

    A block is text between structural tags, with references decoded and white space made one blank.
    The container leaves out trailing text elements such as paragraphs, lists and tables.

    Names, roles and forms do not skip what holds the article: if the text of every innermost article or main
    element is skipped by them alone, they are void around the largest one, and if all text of a page is
    skipped, around the larger part of it.
    """
    paths, found, inside = _blocks(html)
    for around in (_around_article, _around_all):
        if lifted := around(found, inside):
            paths, found, inside = _blocks(html, lifted)
    return paths, found


def _skippers(held):
    """Numbers of the weakly skipped elements in a stack; None if a block is skipped for good."""
    weak = []
    for name, label, number in held:
        if label[0] == "-":
            if name in SKIPPED and name not in WEAK:
                return None
            weak.append(number)
    return weak


def _around_article(found, inside):
    mains, outer = {}, set()
    for (_, skipped, text), held in zip(found, inside):
        numbers = [s[2] for s in held if s[0] in MAIN]
        outer.update(numbers[:-1])
        if numbers and (weak := _skippers(held)) is not None:
            last = max(k for k, s in enumerate(held) if s[0] in MAIN)
            size, free, _ = mains.get(numbers[-1], (0, False, None))
            mains[numbers[-1]] = (size + len(text), free or not skipped, _skippers(held[: last + 1]))
    mains = {k: v for k, v in mains.items() if k not in outer}
    if not mains or any(free for _, free, _ in mains.values()):
        return frozenset()
    return frozenset(max(mains.values(), key=lambda v: v[0])[2])


def _around_all(found, inside):
    if any(not skipped for _, skipped, _ in found):
        return frozenset()
    sizes, total = {}, 0
    for (_, _, text), held in zip(found, inside):
        weak = _skippers(held)
        total += len(text) if weak else 0
        for number in weak or ():
            sizes[number] = sizes.get(number, 0) + len(text)
    return frozenset(k for k, n in sizes.items() if 2 * n >= total) or frozenset(sizes)


def _blocks(html, lifted=frozenset()):
    """As ``blocks``, and the open elements (name, label, number) of each block; weak evidence of ``lifted`` is void."""
    stack, paths, found, inside, parts = [], [], [], [], []
    at = number = 0

    def flush():
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                depth = len(stack)
                while depth and stack[depth - 1][0] in TEXT_BLOCKS:
                    depth -= 1
                skipped = any(s[1][0] == "-" for s in stack)
                found.append(("/".join(s[1] for s in stack[:depth]), skipped, text))
                inside.append(tuple(stack))

    for m in TAG.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            parts.append(m["cdata"].replace("&", "&amp;"))
            continue
        if not m["name"]:
            if m["empty"]:
                flush()
            elif m["raw"]:
                parts.append(" ") if m["raw"].lower() in ("script", "style") else flush()
            continue
        name = m["name"].lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSED_BY_BLOCK and stack and stack[-1][0] == "p":
            stack.pop()
        number += 1
        own = name == "header" and any(s[0] == "article" for s in stack)
        label = _label(name, m["attributes"], number in lifted, own)
        paths.append("/".join([*(s[1] for s in stack), label]))
        if name not in VOID:
            stack.append((name, label, number))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return paths, found, inside


def host_of(url):
    """Host of a URL in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _page_tokens(batches):
    for batch in batches:
        rows = {"host": [], "page": [], "kind": [], "token": [], "skipped": [], "n": [], "chars": []}
        for host, page, html in zip(*[c.to_pylist() for c in batch.columns]):
            paths, found = blocks(html)
            counts = {}
            for p in paths:
                counts[("tag", p, False)] = counts.get(("tag", p, False), 0) + 1
            chars = {}
            for path, skipped, text in found:
                key = ("text", path + "\n" + text, skipped)
                counts[key] = counts.get(key, 0) + 1
                slot = ("slot", path, skipped)
                counts[slot] = counts.get(slot, 0) + 1
                chars[slot] = chars.get(slot, 0) + len(text)
            for (kind, token, skipped), n in counts.items():
                if kind == "text" and skipped:
                    continue
                rows["host"].append(host)
                rows["page"].append(page)
                rows["kind"].append(kind)
                rows["token"].append(token)
                rows["skipped"].append(skipped)
                rows["n"].append(n)
                rows["chars"].append(chars.get((kind, token, skipped), 0))
        types = {"host": pa.string(), "page": pa.int64(), "kind": pa.string(), "token": pa.string(), "skipped": pa.bool_(), "n": pa.int64(), "chars": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in types.items()], names=list(types))


def equivalence_classes(pages):
    """Tokens of each host with their occurrence vector: host, kind, token, skipped, pages, chars, v1, v2.

    ``pages`` has host, page (a hash) and html. Texts are shown by a hash, tags and slots by their path.
    """
    tokens = pages.select("host", "page", "html").mapInArrow(
        _page_tokens, "host string, page long, kind string, token string, skipped boolean, n long, chars long"
    )
    name = F.when(F.col("kind") == "text", F.md5("token")).otherwise(F.col("token"))
    low = lambda seed: F.xxhash64("page", "n", F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (
        tokens.select("host", "kind", name.alias("token"), "skipped", "chars", low(1).alias("a"), low(2).alias("b"))
        .groupBy("host", "kind", "token", "skipped")
        .agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("a").alias("v1"), F.sum("b").alias("v2"))
    )


def templates(tokens):
    """One row per host: main (path of the article's slot) and fixed (texts of the frame's class).

    The frame is the class of the body, or else of the most frequent tag. A class belongs to the template
    if SUPPORT of the host's pages have it and its paths start with those of the frame. Slots are paths
    in the template. All slots below an outermost article or main element count as that element, which comes
    first; then those with most characters.
    """
    frame = tokens.where("kind = 'tag'").groupBy("host").agg(
        F.max_by(F.struct("pages", "v1", "v2"), F.struct("pages", (-F.length("token")).alias("short"), "token")).alias("frame")
    )
    # slots of one element are held by different pages each, so the element has the support of its tag
    container = F.regexp_extract("token", CONTAINER, 1)
    named = container != ""
    frame = frame.join(_chance(tokens, frame), "host", "left")
    joined = tokens.join(frame, "host").where(
        (F.col("pages") >= F.lit(SUPPORT) * F.col("frame.pages")) | (F.col("kind") == "slot") & named
    )
    same = (F.col("v1") == F.col("frame.v1")) & (F.col("v2") == F.col("frame.v2")) & (F.col("pages") == F.col("frame.pages"))
    slot = (F.col("kind") == "slot") & ~F.col("skipped")
    tag = (F.col("kind") == "tag") & (container == F.col("token"))
    text = (F.col("kind") == "text") & same & F.coalesce(F.col("by_chance") < CHANCE, F.lit(False))
    area = F.when(named, container).otherwise(F.col("token"))
    areas = joined.groupBy("host", area.alias("area"), named.alias("named")).agg(
        F.sum(F.when(slot, F.col("chars"))).alias("chars"),
        F.max(tag).alias("has_tag"),
        F.collect_set(F.when(text, F.col("token"))).alias("fixed"),
    )
    main = F.col("chars").isNotNull() & (~F.col("named") | F.col("has_tag"))
    # areas have the support of a large part of the pages, so a host has few of them
    best = areas.groupBy("host").agg(
        F.max_by(F.when(main, F.col("area")), F.when(main, F.struct("named", "chars", "area"))).alias("main"),
        F.collect_list(F.when(main, F.col("area"))).alias("areas"),
        F.flatten(F.collect_list("fixed")).alias("fixed"),
    )
    around = F.filter("areas", lambda a: F.startswith(F.col("main"), F.concat(a, F.lit("/"))) & ~a.rlike(FRAME))
    return best.select("host", F.coalesce(F.get(F.array_sort(around), 0), F.col("main")).alias("main"), "fixed")


def _chance(tokens, frame):
    """(host, by_chance): how many texts would be on every page of the host by chance.

    Of the texts that are not on all pages, the share of pairs of pages that have one in common, one pair
    added, gives the chance that a text of one page is on another; all other pages have it by the power of their number.
    The same rule holds for a host of any size: two pages never show a template, thousands do.
    """
    texts = tokens.where("kind = 'text'").join(frame.select("host", F.col("frame.pages").alias("whole")), "host")
    n = F.col("pages").cast("double")
    varied = F.col("pages") < F.col("whole")
    counts = texts.groupBy("host").agg(
        F.max("whole").cast("double").alias("whole"),
        F.sum(F.when(varied, n).otherwise(0.0)).alias("blocks"),
        F.sum(F.when(varied, n * (n - 1)).otherwise(0.0)).alias("pairs"),
        F.sum(n).alias("all"),
    )
    others = F.col("whole") - 1
    recurs = (F.col("pairs") + 1) / (F.col("blocks") * others + 1)
    chance = F.col("all") / F.col("whole") * F.pow(F.least(recurs, F.lit(1.0)), others)
    return counts.where("whole > 1").select("host", chance.alias("by_chance"))


def _key(text):
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def main_text(html, main, fixed=frozenset()):
    """The article of a page: blocks below ``main``, or in the page's own largest element or slot where it has none."""
    _, found = blocks(html)
    kept = [(path, text) for path, skipped, text in found if not skipped]
    inside = [(p, t) for p, t in kept if main is not None and (p == main or p.startswith(main + "/"))]
    if not inside and kept:
        sizes = {}
        for p, t in kept:
            container = re.match(CONTAINER, p, re.S)
            p, named = (container[1], True) if container else (p, False)
            sizes[p] = (named, sizes.get(p, (named, 0))[1] + len(t))
        best = max(sizes, key=lambda p: (sizes[p], p))
        best = min((p for p in sizes if best.startswith(p + "/") and not re.search(FRAME, p)), key=len, default=best)
        inside = [(p, t) for p, t in kept if p == best or p.startswith(best + "/")]
    varying = [t for p, t in inside if not fixed or _key(p + "\n" + t) not in fixed]
    return "\n".join(varying or [t for _, t in inside])


def _extract(batches):
    for batch in batches:
        ids, urls, htmls, mains, fixed = batch.columns
        cache, texts = {}, []
        for html, main, known in zip(htmls.to_pylist(), mains.to_pylist(), fixed.to_pylist()):
            known = tuple(known or ())
            known = cache.setdefault(known, frozenset(known))
            texts.append(main_text(html, main, known))
        yield pa.RecordBatch.from_arrays(
            [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages):
    """page_id, url, text and n_chars of every page.

    Null html is empty and gives an empty text; pages without a host share one template. Repeated rows
    are extracted each. Without pages there are no rows. Only page_id, url and html are read. Of slots with
    as many characters the path that is last in order counts. Pages of any length are read whole; what a
    tag leaves open ends with its parent or the page, and an open comment or script hides the rest.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host")
    )
    seen = rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    learned = stored(templates(equivalence_classes(seen)), "templates")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return (
        rows.join(learned, "host", "left")
        .select("page_id", "url", "html", "main", "fixed")
        .mapInArrow(_extract, f"page_id {id_type}, url string, text string, n_chars long")
    )
