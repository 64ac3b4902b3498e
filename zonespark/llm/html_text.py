"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: opening tags named by the path they stand at, and texts outside a marked article. Tokens of
one host that occur equally often on each of its pages form an equivalence class. Classes found on most pages, nested by
their paths, are the host's template; what the template does not fix are slots. The main slot is the deepest container
that holds nearly all of the text left in slots; texts that belong to the template are not part of it.

A marked article is evidence for the slot: its text counts where the slot is sought, and it is the page's text unless
more is left in the slot beside it than it holds, as on pages with teaser cards. Texts inside it are never taken for
template. Hosts whose pages have text in articles only need no template row, and documents never move: the template of
a host is joined to the pages where they are read.
"""

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick
from zonespark.llm.url_filter import host_of
from zonespark.shipping import ship_package

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements by their role in a page.
RAW = set("script style noscript template iframe object svg math canvas textarea select xmp noembed noframes plaintext".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
DROPPED = set("head title nav footer aside form button dialog menu input label fieldset option audio video".split()) | RAW
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main"}
#: Words of a class, id or role that mark what is not the article.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar aside complementary footer contentinfo header masthead cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments reply replies respond disqus widget toolbar pagination pager search skip form".split()
)
_ROLE_OF_HEADERS = {"header", "masthead"}
_COMMENTS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
MAIN = {"article", "main"}
#: Elements that may stand in a head; any other one ends it, as does a text.
IN_HEAD = {"head", "title", "base", "basefont", "bgsound", "link", "meta"} | RAW

EXCLUDED, IN_MAIN, OPEN, FORM_IN_MAIN, FORM = range(5)
#: What a form makes of the state around it. Whether it wraps the page or is a part of it shows when the page is read.
FORMS = {IN_MAIN: FORM_IN_MAIN, OPEN: FORM}
#: Elements below this depth share the path of the one at it, so paths stay short on any page.
DEEPEST = 48


@dataclass
class Page:
    """(path, state, text) of every block that may be text of the page, and how often every opening tag occurs."""

    blocks: list[tuple[str, int, str]] = field(default_factory=list)
    tags: Counter = field(default_factory=Counter)


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" \t\n\r\f/") else {}


def _state(name: str, attributes: dict[str, str], outer: int) -> int:
    if outer == EXCLUDED or name in DROPPED and name != "form":
        return EXCLUDED
    words = set()
    if attributes:
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
            return EXCLUDED
        named = " ".join(attributes.get(a, "") for a in ("class", "id", "role"))
        words = {w.lower() for w in _WORDS.findall(named)} & MARKS
    if name in MAIN:
        return EXCLUDED if words & _COMMENTS else FORM_IN_MAIN if outer == FORM_IN_MAIN else IN_MAIN
    if name == "form":
        return EXCLUDED if words - {"form"} else FORMS.get(outer, outer)
    if outer in (IN_MAIN, FORM_IN_MAIN):
        words -= _ROLE_OF_HEADERS
    elif name == "header":
        return EXCLUDED
    return EXCLUDED if words and name not in ("html", "body") else outer


def _step(name: str, attributes: dict[str, str]) -> str:
    """How a tag is written in a path: with its id and first class, numbers left out."""
    first = attributes.get("class", "").split()
    marks = ("#" + attributes["id"] if attributes.get("id") else "") + ("." + first[0] if first else "")
    return name + re.sub(r"\d+", "0", marks).replace("/", "_")


def _tag_end(html: str, at: int) -> int:
    """Where the tag that is open at a place ends: at the next > outside quotes, or at any if a quote is never closed."""
    end = html.find(">", at)
    while end >= 0:
        quote = min((q for q in (html.find('"', at, end), html.find("'", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end
        closing = html.find(html[quote], quote + 1)
        if closing < 0:
            return end
        at = closing + 1
        end = end if at <= end else html.find(">", at)
    return -1


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, open and close tags in order. Comments, declarations and raw contents are left out."""
    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            break
        name = _NAME.match(html, start + 1)
        if name is None:
            if html.startswith(("<!", "<?", "</"), start):
                yield "text", "", html[at:start]
                comment = html.startswith("<!--", start) and not html.startswith(("<!-->", "<!--->"), start)
                closing = "-->" if comment else ">"
                end = html.find(closing, start + 4 if comment else start)
                at = size if end < 0 else end + len(closing)
            else:
                yield "text", "", html[at : start + 1]
                at = start + 1
            continue
        end = _tag_end(html, name.end())
        if end < 0:
            break
        yield "text", "", html[at:start]
        at = end + 1
        if name[0][0] == "/":
            yield "close", name[0][1:].lower(), ""
            continue
        kind = name[0].lower()
        yield "open", kind, html[name.end() : end]
        if kind in RAW:
            close = re.compile(f"</{re.escape(kind)}", re.IGNORECASE).search(html, at)
            at = close.start() if close else size
    yield "text", "", html[at:]


def _settled(blocks: list[tuple[str, int, str]]) -> list[tuple[str, int, str]]:
    """Blocks with the texts of forms kept where forms hold more text than stands beside them, and left out elsewhere."""
    if not any(state in (FORM_IN_MAIN, FORM) for _, state, _ in blocks):
        return blocks
    chars = Counter()
    for _, state, text in blocks:
        chars[state] += len(text)
    become = {formed: plain if chars[formed] > chars[plain] else EXCLUDED for plain, formed in FORMS.items()}
    settled = ((path, become.get(state, state), text) for path, state, text in blocks)
    return [b for b in settled if b[1] != EXCLUDED]


def read_page(html: str) -> Page:
    """Blocks and tags of a page; unclosed, stray and nested tags are tolerated as browsers do in common cases."""
    page, stack, parts, opened = Page(), [("", "", OPEN)], [], Counter()

    def flush() -> None:
        text = " ".join(references.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text and stack[-1][2] != EXCLUDED:
            page.blocks.append((stack[-1][1], stack[-1][2], text))

    def close_from(depth: int) -> None:
        opened.subtract(s[0] for s in stack[depth:])
        del stack[depth:]

    def end_head() -> None:
        flush()
        close_from(next(depth for depth, s in enumerate(stack) if s[0] == "head"))

    for kind, name, rest in _tokens(html):
        if kind == "text":
            if rest:
                if stack[-1][0] == "head" and rest.strip():
                    end_head()
                # Labels and the like stand in the line of a form's texts, so they are left out where they are read.
                if not (opened["form"] > 0 and stack[-1][2] == EXCLUDED):
                    parts.append(rest)
        elif name == "br":
            parts.append(" ")
        elif kind == "close":
            if opened[name] > 0:
                if name in BLOCK:
                    flush()
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close_from(depth)
        else:
            if opened["head"] > 0 and (name == "body" or name not in IN_HEAD and not opened["title"]):
                end_head()
            if name in BLOCK:
                flush()
                # A new block ends an open paragraph, and a list item or cell ends the one before it.
                for names in ({"p"}, ENDS_ITSELF.get(name, set())):
                    if any(opened[n] > 0 for n in names):
                        for depth in range(len(stack) - 1, 0, -1):
                            if stack[depth][0] in names:
                                close_from(depth)
                                break
                            if stack[depth][0] in SCOPES:
                                break
            attributes = _attributes(rest)
            _, here, outer = stack[-1]
            if name in BLOCK:
                if len(stack) <= DEEPEST:
                    here = f"{here}/{_step(name, attributes)}"
                page.tags[here] += 1
            if name not in VOID and not (rest.endswith("/") and name not in BLOCK):
                stack.append((name, here, _state(name, attributes, outer)))
                opened[name] += 1
    flush()
    page.blocks = _settled(page.blocks)
    return page


def block_token(path: str, text: str) -> int:
    """Name of a text at its place, as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def main_text(page: Page, slot: str | None, fixed: set[int], judged: bool = False) -> str:
    """What the host's main slot holds beside the template's own texts, or the article if the page marks one.

    With `judged` the host has pages enough to judge by, and an article only counts if it holds as much as is left beside it.
    """
    marked = [b for b in page.blocks if b[1] == IN_MAIN]
    if marked and not judged:
        return "\n".join(text for _, _, text in marked)
    inside = [b for b in page.blocks if slot is None or b[0] == slot or b[0].startswith(slot + "/")]
    chosen = [b for b in inside or page.blocks if b[1] == IN_MAIN or block_token(b[0], b[2]) not in fixed]
    if marked and sum(len(text) for _, state, text in chosen if state != IN_MAIN) <= sum(len(text) for _, _, text in marked):
        chosen = marked
    return "\n".join(text for _, _, text in chosen)


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per host, page and token: host, row, token, path, kind, times, chars.

    The kind is tag, text (outside marked articles) or main (all texts inside marked articles at one path).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                for host, row, html in zip(*(batch.slice(at, 512).column(n).to_pylist() for n in range(3))):
                    page = read_page(html)
                    out += [(host, row, block_token(p, ""), p, "tag", n, 0) for p, n in page.tags.items()]
                    texts = Counter((p, t) for p, state, t in page.blocks if state == OPEN)
                    out += [(host, row, block_token(p, t), p, "text", n, n * len(t)) for (p, t), n in texts.items()]
                    held = Counter()
                    for p, state, t in page.blocks:
                        if state == IN_MAIN:
                            held[p] += len(t)
                    out += [(host, row, block_token(p, "\n"), p, "main", 1, n) for p, n in held.items()]
                if out:
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["host", "row", "token", "path", "kind", "times", "chars"]
    schema = "host string, row long, token long, path string, kind string, times long, chars long"
    return pages.select("host", "row", "html").mapInArrow(read, schema)


def deduce_templates(
    pages: DataFrame, least_pages: int = 5, least_share: float = 0.8, slot_share: float = 0.85, least_group: float = 0.2
) -> DataFrame:
    """host, slot, fixed, judged for hosts with text outside marked articles: the main slot's path, the tokens of
    template texts, and whether the host has `least_pages`.

    Texts and pages are counted over all pages, marked or not. A class counts if its tokens stand on `least_pages` at
    least and on `least_share` of the pages with the same container tag, which is on `least_group` of the host's pages,
    and if it has a tag and a text or two texts, as a single coinciding text proves nothing; it nests in the template
    where its paths continue the path of a tag of a counting class. The slot is the deepest container with `slot_share`
    of the other text, that of articles included.
    """
    hashed = F.xxhash64("row", "times")
    tokens = keep(
        page_tokens(pages).groupBy("host", "token", "path", "kind").agg(
            F.count("*").alias("pages"), F.sum("chars").alias("chars"),
            # Equal sums of both halves stand for equal occurrence vectors.
            F.sum(hashed.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v1"), F.sum(F.shiftrightunsigned(hashed, 33)).alias("v2"),
        )
    )
    unmarked = tokens.filter("kind = 'text'").select("host").distinct()
    sizes = pages.groupBy("host").agg(F.count("*").alias("host_pages")).join(keep(unmarked), "host")
    sizes = keep(sizes)
    known = tokens.join(sizes, "host")
    groups = known.filter("kind = 'tag'").select("host", "path", F.col("pages").alias("group_pages"))
    # A text outside all containers has the host's pages for its group.
    grouped = known.filter("kind <> 'main'").join(groups, ["host", "path"], "left").withColumn("group_pages", F.coalesce("group_pages", "host_pages"))
    frequent = grouped.filter(
        (F.col("pages") >= least_pages) & (F.col("pages") >= least_share * F.col("group_pages"))
        & (F.col("group_pages") >= least_group * F.col("host_pages"))
    )
    classes = frequent.groupBy("host", "pages", "v1", "v2").agg(F.count("*").alias("size"))
    valid = keep(frequent.join(classes.filter("size >= 2"), ["host", "pages", "v1", "v2"]).select("host", "token", "path", "kind"))
    # A text nests in the template if the tag it stands in belongs to it as well.
    tags = valid.filter("kind = 'tag'").select("host", "path").distinct()
    fixed = keep(valid.filter("kind = 'text'").join(tags, ["host", "path"], "left_semi").select("host", "token"))
    left = known.filter("kind <> 'tag'").join(fixed, ["host", "token"], "left_anti").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    held = (
        left.filter(F.size(steps) >= 2).withColumn("slot", F.explode(above)).groupBy("host", "slot").agg(F.sum("chars").alias("chars"))
    )
    whole = left.groupBy("host").agg(F.sum("chars").alias("all"))
    slots = (
        held.join(whole, "host").filter(F.col("chars") >= slot_share * F.col("all"))
        .groupBy("host").agg(F.max_by("slot", F.struct(F.size(F.split("slot", "/")), "chars", "slot")).alias("slot"))
    )
    # Template texts stand on most pages of a host, so a host has no more of them than a page or two have texts.
    texts = fixed.groupBy("host").agg(F.collect_set("token").alias("fixed"))
    return keep(sizes.select("host", (F.col("host_pages") >= least_pages).alias("judged")).join(slots, "host", "left").join(texts, "host", "left"))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    reader comments; blocks in page order, one per line. A null html counts as empty and gives an empty text; a null url
    counts as a host of its own together with those that name none. Repeated rows come out repeated, and count as pages
    of their host. An empty table gives an empty result; columns other than page_id, url and html are ignored.
    """
    ship_package(pages.sparkSession)
    rows = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    templates = deduce_templates(rows.select("host", "html", F.monotonically_increasing_id().alias("row")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = (part.column(n).to_pylist() for n in ("html", "slot", "fixed", "judged"))
                texts = [main_text(read_page(html), slot, set(fixed or ()), bool(judged)) for html, slot, fixed, judged in zip(*columns)]
                found = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(found, ["page_id", "url", "text", "n_chars"])

    # Spark broadcasts the templates if it finds them small, and otherwise splits hosts with many pages.
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "slot", "fixed", "judged")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
