"""HTML extraction: the blocks of a page without the subtrees that its host repeats.

Subtrees are hashed in two ways: with their texts, and by their form alone (tags, classes and ids
without digits, roles, repeated siblings once, and the path from the page's root). A form that stands around many different main texts
of a host, and is on average a small part of the page outside its bulk, is the site's frame,
whatever its texts; a subtree that recurs with its texts is a template wherever it stands,
except in the running text of a marked article. Lists of tag, role and class names are the prior
for hosts with too few pages and for frames that occur on few of them.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import aside, chunks
from tidemark.session import cut, scratch, table

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noframes xmp title svg math canvas object audio video select".split())
FRAME = frozenset("nav footer aside form button menu dialog head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words of a class or id that mark what is no article.
FRAME_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " masthead menu nav navbar navigation newsletter notice pager pagination popup promo related reply replies respond"
    " share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: An open element of the first kind ends before a start tag of the second.
ENDS = {
    "p": BLOCK,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option"}),
}
SCOPE = frozenset("article aside body div footer header html main nav ol section table td th ul form".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Node:
    """An element; ``parts`` are texts and elements in order."""

    name: str
    parent: "Node | None"
    frame: bool = False
    main: bool = False
    label: str = ""
    parts: list = field(default_factory=list)
    size: int = 0
    path: int = 0
    form: int = 0
    exact: int = 0


def parse(page: str) -> Node:
    """A tree of elements and decoded texts; end tags that are missing are supplied."""
    root = Node("#root", None)
    at, place, n = root, 0, len(page)
    while place < n:
        m = TAG.search(page, place)
        if m is None:
            at.parts.append(entities.unescape(page[place:]))
            break
        if m.start() > place:
            at.parts.append(entities.unescape(page[place : m.start()]))
        place = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            node = at
            while node.parent is not None and node.name != name and not (node.name in SCOPE and name not in SCOPE):
                node = node.parent
            if node.name == name and node.parent is not None:
                at = node.parent
            continue
        while at.name in ENDS and name in ENDS[at.name]:
            at = at.parent
        if at.name not in BLOCK and name in BLOCK:  # a p around open inline elements ends too
            up = at
            while up.parent is not None and up.name not in BLOCK:
                up = up.parent
            if up.name == "p":
                at = up.parent
        node = Node(name, at)
        node.frame, node.main, node.label = _marks(name, m[3], at)
        at.parts.append(node)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, place)
            close = page.find(">", end.start()) if end else -1
            place = close + 1 if close >= 0 else n
            continue
        at = node
    return root


def _marks(name: str, attributes: str, parent: Node) -> tuple[bool, bool, str]:
    """Whether an element belongs to the frame of a page by its names, whether it is its main part, and
    its tag with class, id and role, for its form."""
    frame = name in FRAME or name in RAW or (name == "header" and parent.name not in ("article", "main", "section"))
    main, label = name in ("article", "main"), name
    if attributes.strip():
        a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)}
        role = a.get("role", "").lower()
        names = set(re.split(r"[^a-z]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
        main = main or role == "main"
        frame = frame or role in ROLES or bool(hidden) or (bool(names & FRAME_NAMES) and name not in ("html", "body", "article", "main"))
        label = f"{name}.{' '.join(sorted(names))}@{role}"
    return frame, main, label


def mains(root: Node) -> list[Node]:
    """The outermost main parts outside the frame; the whole page if it names none.

    An article inside a frame element, such as a reader's comment, is no main part.
    """
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.main:
            found.append(node)
        elif not node.frame:
            todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    named = [n for n in found if any(isinstance(p, Node) or p.strip() for p in n.parts)]
    return named or [root]


#: Blocks that are running text of an article and never a template there.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th tbody thead tfoot figcaption html body".split())
#: Blocks that are the page itself.
WHOLE = frozenset("html body".split())


def measure(root: Node) -> None:
    """Gives every element the size of its text (raw elements count nothing), the
    hash of its form, and that of its tags and texts."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.path = xxhash.xxh64_intdigest(f"{node.parent.path if node.parent else 0:x}>{node.label}".encode("utf-8", "surrogatepass"))
        todo.extend(p for p in node.parts if isinstance(p, Node))
    for node in reversed(order):  # children first
        size, forms, exact = 0, [], [node.name]
        for p in node.parts:
            if isinstance(p, Node):
                size += p.size
                form = f"{p.form:x}"
                exact.append(f"<{p.exact:x}>")
            elif words := p.split():
                size += sum(map(len, words))
                form = "t"
                exact.append(" ".join(words))
            else:
                continue
            if not forms or forms[-1] != form:
                forms.append(form)
        node.form = xxhash.xxh64_intdigest(f"{node.label}({','.join(forms)})".encode("utf-8", "surrogatepass"))
        node.exact = xxhash.xxh64_intdigest(" ".join(exact).encode("utf-8", "surrogatepass"))
        node.size = 0 if node.name in RAW else size


def bulk(root: Node) -> Node:
    """The deepest element that holds at least half of the page's text."""
    at = root
    while True:
        inner = max((p for p in at.parts if isinstance(p, Node)), key=lambda p: p.size, default=None)
        if inner is None or inner.size * 2 < max(root.size, 1) or inner.name in PROSE - WHOLE:
            return at
        at = inner


def _signed(h: int) -> int:
    return h - (1 << 63)


def dissect(page: str, names: bool = True) -> tuple[list[tuple[str, list[int], bool]], list[tuple]]:
    """All blocks of text in page order, and the subtrees that may be templates.

    A block comes with the numbers of the candidate subtrees around it, and with whether the lists of names put it
    in the frame (``framed``; never without ``names``). A candidate is ``(number, hash, share, inside, exact, article)``: its
    share of the page's text, whether it lies in the page's bulk, whether the hash is of its texts or of its form, and whether it is part of
    a named article. All block elements are candidates by their texts but the page itself, and by form those that are no running text.
    """
    root = parse(page)
    measure(root)
    tops = mains(root) if names else [root]
    inside = {id(t) for t in tops}
    marked = tops[0] is not root
    core = bulk(root)
    around = set()
    up: Node | None = core
    while up is not None:
        around.add(id(up))
        up = up.parent
    if marked:
        for t in tops:
            up = t
            while up is not None:
                inside.add(id(up)) if up is t else around.add(id(up))
                up = up.parent
    total = max(root.size, 1)
    out: list[tuple[str, list[int], bool]] = []
    trees: list[tuple] = []
    buffer: list[str] = []
    owners: list[int] = []
    now = False  # whether the buffer's text is taken

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append((text, owners.copy(), not now))

    # (node, whether the lists take its text, whether it is in the bulk); None closes a block, an int closes a candidate, a bool sets back what is taken
    todo: list = [(root, not marked, False)]
    number = 0
    while todo:
        p = todo.pop()
        if p is None:
            flush()
            continue
        if isinstance(p, bool):
            now = p
            continue
        if isinstance(p, int):
            flush()
            owners.pop()
            continue
        node, taken, held = p
        if isinstance(node, str):
            now = taken
            buffer.append(node)
            continue
        if node.name in RAW:
            continue
        if node.name == "br":
            buffer.append(" ")
            continue
        framed = names and node.frame
        if framed and node.name not in BLOCK:  # recurrence cannot tell what stands within a line
            continue
        taken = (taken or id(node) in inside) and not framed
        held = held or node is core
        if node.name in BLOCK:
            flush()
            todo.append(None)
            hashes = []
            article = marked and taken
            if node.name not in WHOLE and node is not root:
                hashes.append((number, _signed(node.exact), node.size / total, held or id(node) in around, True, article and node.name in PROSE))
            if id(node) not in inside and node.name not in PROSE:
                hashes.append((number, _signed(xxhash.xxh64_intdigest(f"{node.path:x}{node.form:x}".encode())), node.size / total, held or id(node) in around, False, article))
            if hashes:
                trees.extend(hashes)
                owners.append(number)
                todo.append(number)
                number += 1
        for part in reversed(node.parts):
            todo.append((part, taken, held))
    flush()
    return out, trees


def host(url):
    """The host of an address, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("owners", pa.list_(pa.int32())), ("framed", pa.bool_())]))
TREES = pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64()), ("share", pa.float32()), ("inside", pa.bool_()), ("exact", pa.bool_()), ("article", pa.bool_())]))


def dissected(pages: DataFrame, names: bool = True) -> DataFrame:
    """``pages`` without ``html``, with ``_host``, ``_page`` (hash of the html), ``_main`` (hash of its
    text), ``_blocks`` and ``_trees``."""
    source = pages.withColumn("_host", host(F.col("url")))
    kept = [c for c in source.columns if c != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema)
    schema += ", _page long, _main long, _blocks array<struct<text:string,owners:array<int>,framed:boolean>>, _trees array<struct<place:int,hash:long,share:float,inside:boolean,exact:boolean,article:boolean>>"
    out_names = [*kept, "_page", "_main", "_blocks", "_trees"]

    def digest(t: str) -> int:
        return _signed(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")))

    def run(batches):
        for part, texts in chunks(batches, "html"):
            found = [dissect(t, names) for t in texts]
            cols = [part.column(c) for c in kept]
            cols.append(pa.array([digest(t) for t in texts], pa.int64()))
            cols.append(pa.array([digest("\n".join(b for b, _, framed in blocks if not framed)) for blocks, _ in found], pa.int64()))
            cols.append(pa.array([[{"text": b, "owners": o, "framed": f} for b, o, f in blocks] for blocks, _ in found], BLOCKS))
            cols.append(pa.array([[dict(zip(("place", "hash", "share", "inside", "exact", "article"), t)) for t in trees] for _, trees in found], TREES))
            yield pa.RecordBatch.from_arrays(cols, names=out_names)

    return source.mapInArrow(run, schema)


#: Different main texts from which on a host's recurring subtrees alone decide; below, the lists of names help.
PLENTY = 10


def host_mains(found: DataFrame) -> DataFrame:
    """``(_host, mains)``: how many different main texts a host has."""
    return found.select("_host", "_main").distinct().groupBy("_host").agg(F.count("*").alias("mains"))


def templates(found: DataFrame, total: DataFrame | None = None, least: int = 3, share: float = 0.02, enough: int = 50, small: float = 0.2, most: float = 0.5, plenty: int = PLENTY) -> DataFrame:
    """``(_host, hash, n)`` of subtrees around at least ``least`` different main texts of a host, and
    a ``share`` of its different main texts or ``enough`` of them.

    A form must be on average at most ``small`` of the page and more often outside its bulk than inside, as
    articles are built alike. A text that is more often inside the bulk is a template only around ``most`` of
    the host's main texts: a passage that some of its articles repeat is theirs. On a host of fewer than ``plenty`` main texts
    what is in a named article is none. Trees without these fields are texts outside the bulk.

    Pages with the same main text count once on both sides, so copies of an article neither make
    a template of it nor hide one, and what recurs often enough goes however large the host is.
    Counts are combined before each shuffle: a large host is no large task.
    """
    fields = found.schema["_trees"].dataType.elementType.fieldNames()
    plain = {"share": F.lit(0.0), "inside": F.lit(False), "exact": F.lit(True), "article": F.lit(False)}
    known = [(F.col(f"t.{c}") if c in fields else v).alias(c) for c, v in plain.items()]
    each = found.select("_host", "_main", F.explode("_trees").alias("t")).select("_host", "_main", "t.hash", *known)
    each = each.groupBy("_host", "hash", "_main").agg(F.max("share").alias("part"), F.max(F.col("inside").cast("int")).alias("inside"), F.max("exact").alias("exact"), F.max("article").alias("article"))
    n = each.groupBy("_host", "hash").agg(F.count("*").alias("n"), F.avg("part").alias("part"), F.avg("inside").alias("inside"), F.max("exact").alias("exact"), F.max("article").alias("article"))
    n = n.where((F.col("n") >= least) & (F.col("exact") | ((F.col("part") <= small) & (F.col("inside") < 0.5))))
    n = n.join(total if total is not None else host_mains(found), "_host").where((F.col("mains") >= plenty) | ~F.col("article"))
    often = F.when(F.col("inside") < 0.5, F.least(share * F.col("mains"), F.lit(enough))).otherwise(most * F.col("mains"))
    return n.where(F.col("n") >= often).select("_host", "hash", "n")


def extract(pages: DataFrame, names: bool = True, salt: int = 16, small: int = 100_000) -> DataFrame:
    """``pages`` (``page_id, url, html, ...``) with ``text`` (blocks joined by an empty line; empty if
    none), ``n_chars``, ``n_templates`` (recurring subtrees cut out of the page around its text) and
    ``n_recurring`` (all recurring subtrees of the page, those without text too).

    Subtrees that recur across a host's pages with different main texts go. On hosts of ``PLENTY`` different main texts or more
    that alone decides between blocks; on others, frames named by tags, roles, classes or ids go, too (not without
    ``names``). Pages are parsed once. The templates of each host, and whether it has plenty, meet its pages in a broadcast while
    both are at most ``small`` in all, by count; beyond that in a join on the host that is dealt out by page, so that a large
    host does not meet in one task: both give the same result. A null html counts as empty, a null
    url as a host of its own; ids may repeat or be null; an empty table gives an empty result; a
    very long page is one row like any other. Columns of those names are replaced, ``html`` is
    dropped, others are kept, whatever their names.
    """
    made = ["text", "n_chars", "n_templates", "n_recurring"]
    return aside(pages, ("url", "html"), made, lambda p: _extract(p, names, salt, small)).select(*[c for c in pages.columns if c not in made and c != "html"], *made)


def _extract(pages: DataFrame, names: bool, salt: int, small: int) -> DataFrame:
    path = scratch(pages.sparkSession)
    dissected(pages, names).write.option("compression", "zstd").parquet(path)
    found = pages.sparkSession.read.parquet(path)
    total = cut(host_mains(found))
    marked = cut(templates(found, total))
    plenty = total.select("_host", (F.col("mains") >= (PLENTY if names else 0)).alias("_plenty"))
    if max(marked.count(), total.count()) <= small:
        by_host = marked.groupBy("_host").agg(F.collect_set("hash").alias("_hashes"))
        joined = found.join(F.broadcast(plenty), "_host").join(F.broadcast(by_host), "_host", "left")
        hit = F.filter("_trees", lambda t: F.coalesce(F.array_contains("_hashes", t["hash"]), F.lit(False)))
        joined = joined.withColumn("_drop", F.array_distinct(F.transform(hit, lambda t: t["place"])))
    else:
        every = F.explode(F.array(*[F.lit(i) for i in range(salt)])).alias("_deal")
        deal = F.pmod("_page", F.lit(salt)).cast("int")
        tree = found.select("_host", "_page", F.explode("_trees").alias("t")).select("_host", "_page", "t.place", "t.hash")
        tree = tree.distinct().withColumn("_deal", deal)
        drop = cut(tree.join(marked.select("_host", "hash", every), ["_host", "hash", "_deal"]).groupBy("_host", "_page").agg(F.collect_set("place").alias("_drop")))
        joined = found.withColumn("_deal", deal).join(plenty.select("_host", "_plenty", every), ["_host", "_deal"]).join(drop, ["_host", "_page"], "left")
    dropped = F.coalesce("_drop", F.array().cast("array<int>"))
    kept = F.filter("_blocks", lambda b: ~F.arrays_overlap(b["owners"], dropped) & (F.col("_plenty") | ~b["framed"]))
    joined = joined.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n"))
    cut_out = F.array_intersect(F.array_distinct(F.flatten(F.transform("_blocks", lambda b: b["owners"]))), dropped)
    joined = joined.withColumn("n_templates", F.size(cut_out).cast("long")).withColumn("n_recurring", F.size(dropped).cast("long"))
    return joined.withColumn("n_chars", F.length("text").cast("long"))


def op4_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_templates", "n_recurring")
