"""JSON documents of any size, read in parts: no document has to fit a value or a task.

A file is cut into splits of bytes. Whether a split begins inside a string, and how deep in the document, is not known until all
before it is read; so each split first tells what it would do from each possible start (outside a string, inside one, after a
backslash there), these answers are composed along the document, and then every split is cut with its true start. The cut is
at depth two: elements of the document's own members become rows of their own, and what is left, with the place of its
opening bracket standing for the elements of a member, is a small skeleton that is parsed like any document. A gzip file (`.gz`) is one
split, however long it is: it can be read from its beginning only.
"""

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.functions import variants as V
from zonespark.plans.ordering import dealt, materialise
from zonespark.shipping import ship_package
from zonespark.sources.ranged import open_file

#: Bytes of a split, bytes read at a time, and the longest first line that is looked at to tell records from a document.
SPLIT, _BLOCK, _FIRST_LINE = 8 << 20, 1 << 20, 16 << 20
_OUTSIDE, _INSIDE, _ESCAPED = range(3)
_BLANK = b" \t\r\n"
#: Kinds of bytes that mean something in JSON; all others are 0.
_QUOTE, _SLASH, _OPENS, _CLOSES, _COMMAS = range(1, 6)
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((_QUOTE, b'"'), (_SLASH, b"\\"), (_OPENS, b"[{"), (_CLOSES, b"]}"), (_COMMAS, b",")):
    _KINDS[list(_bytes)] = _kind
#: Files that are read inflated, and the most bytes that one of theirs may stand for.
GZIP, _INFLATED = ".gz", 1100

_SPLITS = "document string, path string, base long, start long, stop long"
_PIECES = (
    "document string, split long, at long, kind int, container long, first boolean, starts boolean, ends int, piece binary"
)
_ARROW = pa.schema(
    [("document", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("container", pa.int64()),
     ("first", pa.bool_()), ("starts", pa.bool_()), ("ends", pa.int32()), ("piece", pa.binary())]
)
#: Kinds of pieces, and how an element's piece ends: with the split, at a comma, or with the member.
_SKELETON, _ELEMENT, _LAST_OPENED = range(3)
_GOES_ON, _COMMA, _CLOSED = range(3)


def _marks(block: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places and kinds of the bytes that mean something, whether the byte after the block is escaped).

    Few bytes of a document do, so all else is done with their places alone. Quotes that a backslash escapes are left out, and so are backslashes.
    """
    kinds = _KINDS[block]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    slashes = at[kinds == _SLASH]
    if not len(slashes) and not escaped:
        return at, kinds, False
    # Backslashes that stand together are a run; the byte after a run of odd length is escaped.
    starts = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    lengths = np.diff(starts, append=len(slashes))
    firsts = slashes[starts]
    if escaped and (not len(firsts) or firsts[0] != 0):
        # An empty run before the block, that counts as one.
        firsts, lengths = np.insert(firsts, 0, 0), np.insert(lengths, 0, 0)
    odd = lengths + (escaped & (np.arange(len(lengths)) == 0))
    after = (firsts + lengths)[odd % 2 == 1]
    kept = (kinds != _SLASH) & ~((kinds == _QUOTE) & np.isin(at, after))
    return at[kept], kinds[kept], bool(len(after) and after[-1] == len(block))


def _outside(kinds: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """(which marks lie outside strings, whether the block ends inside one)."""
    within = (np.cumsum(kinds == _QUOTE) + inside) % 2 == 1
    return ~within, bool(within[-1]) if len(within) else inside


def _state(inside: bool, escaped: bool) -> int:
    return _ESCAPED if inside and escaped else _INSIDE if inside else _OUTSIDE


def outcomes(blocks: Iterator[bytes]) -> list[tuple[int, int]]:
    """(state at the end, change of depth) of some bytes for each state they may begin in."""
    lanes = [(state, 0) for state in (_OUTSIDE, _INSIDE, _ESCAPED)]
    for raw in blocks:
        block, known, read = np.frombuffer(raw, np.uint8), {}, {}
        for i, (state, depth) in enumerate(lanes):
            if state not in known:
                begun = state == _ESCAPED
                if begun not in read:
                    read[begun] = _marks(block, begun)
                _, kinds, escaped = read[begun]
                outside, inside = _outside(kinds, state != _OUTSIDE)
                change = np.count_nonzero(outside & (kinds == _OPENS)) - np.count_nonzero(outside & (kinds == _CLOSES))
                known[state] = _state(inside, escaped), change
            lanes[i] = known[state][0], depth + known[state][1]
    return lanes


def cut(blocks: Iterator[bytes], state: int, depth: int, at: int) -> Iterator[tuple]:
    """Pieces of some bytes that stand at a place of a document, begun in a state and at a depth: (at, kind, container, first, starts, ends, piece).

    Elements of a member opened in an earlier split have no container here. `first` says that an element stands right after the
    opening bracket, `starts` that its beginning is in the piece.
    """
    container, first, starts = None, False, False
    skeleton, skeleton_at, element, element_at = [], at, [], at
    for raw in blocks:
        places, kinds, escaped = _marks(np.frombuffer(raw, np.uint8), state == _ESCAPED)
        outside, inside = _outside(kinds, state != _OUTSIDE)
        state = _state(inside, escaped)
        places, kinds = places[outside], kinds[outside]
        steps = (kinds == _OPENS).astype(np.int64) - (kinds == _CLOSES)
        after = depth + np.cumsum(steps)
        events = ((steps == 1) & (after == 2)) | ((steps == -1) & (after == 1)) | ((kinds == _COMMAS) & (after == 2))
        done, deep = 0, depth >= 2
        for e, step in zip(places[events].tolist(), steps[events].tolist()):
            if step == 1:
                skeleton.append(raw[done : e + 1])
                container = at + e
                yield skeleton_at, _SKELETON, container, None, None, None, b"".join(skeleton)
                skeleton, element, first, starts, deep = [], [], True, True, True
            else:
                element.append(raw[done:e])
                closed = step == -1
                yield element_at, _ELEMENT, container, first, starts, _CLOSED if closed else _COMMA, b"".join(element)
                element, first, starts, deep = [], False, not closed, not closed
                if closed:
                    skeleton, skeleton_at, container = [raw[e : e + 1]], at + e, None
            done = e + 1
            element_at = at + done
        (element if deep else skeleton).append(raw[done:])
        depth = int(after[-1]) if len(after) else depth
        at += len(raw)
    if depth >= 2:
        yield element_at, _ELEMENT, container, first, starts, _GOES_ON, b"".join(element)
        if container is not None:
            yield at, _LAST_OPENED, container, None, None, None, None
    elif skeleton:
        yield skeleton_at, _SKELETON, None, None, None, None, b"".join(skeleton)


def packed(path: Column) -> Column:
    return path.endswith(GZIP)


def room(path: Column, length: Column) -> Column:
    """Bytes that a file takes in a document at most: of a packed one it is not known what it holds until it is read."""
    return F.when(packed(path), (length + 1) * _INFLATED).otherwise(length)


def _inflated(path: str) -> Iterator[bytes]:
    """The bytes that a gzip file holds. One that is broken or ends too soon ends with a byte that no JSON has."""
    with open_file(path) as handle, gzip.GzipFile(fileobj=handle) as held:
        try:
            while block := held.read(_BLOCK):
                yield block
        except (OSError, EOFError, zlib.error):
            yield b"\0"


def _blocks(path: str, start: int, stop: int) -> Iterator[bytes]:
    if path.endswith(GZIP):
        # Read as a whole, by the one split it has.
        yield from _inflated(path)
        return
    with open_file(path) as handle:
        while start < stop:
            block = handle.read_at(min(_BLOCK, stop - start), start)
            if not block:
                break
            yield block
            start += len(block)


def _lines(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin between two places of a file."""
    if path.endswith(GZIP):
        yield from _all_lines(_inflated(path))
        return
    with open_file(path) as handle:
        size, at, rest, rest_at = handle.size(), start, b"", start
        skipping = start > 0
        if skipping:
            # A line begins here only if the byte before ends one.
            at = start - 1
        while at < size and (rest_at < stop or skipping):
            block = handle.read_at(min(_BLOCK, size - at), at)
            if skipping:
                end = block.find(b"\n")
                at += len(block) if end < 0 else end + 1
                if end < 0:
                    if at >= stop:
                        return
                    continue
                skipping, rest_at = False, at
                if at >= stop:
                    return
                block = block[end + 1 :]
                at += len(block)
            else:
                at += len(block)
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if rest_at >= stop:
                    return
                yield rest_at, line
                rest_at += len(line) + 1
        if rest and rest_at < stop:
            yield rest_at, rest


def _all_lines(blocks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    rest, at = b"", 0
    for block in blocks:
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        for line in lines:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def _splits(files: DataFrame) -> DataFrame:
    """Splits of files (document, path, base: where the file stands in the document, length), spread over tasks. A packed file is one split."""
    last = F.when(packed(F.col("path")), F.lit(0)).otherwise(F.greatest(F.col("length") - 1, F.lit(0)))
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(SPLIT).cast("long"))
    cut_up = files.select("document", "path", "base", "length", F.explode(starts).alias("start"))
    stop = F.when(packed(F.col("path")), F.col("length")).otherwise(F.least(F.col("start") + SPLIT, F.col("length")))
    return dealt(cut_up.select("document", "path", "base", "start", stop.alias("stop")), "path", "start")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path as Spark lists them (path, length). Their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def with_kinds(files: DataFrame) -> DataFrame:
    """Files (path, length) with `records`: whether their first line that is not blank is a JSON value of its own; and `blank`: whether there is none."""
    ship_package(files.sparkSession)

    def first_line(path: str) -> str | None:
        held = b""
        for block in _blocks(path, 0, 1 << 62):
            held = (held + block).lstrip(_BLANK)
            end = held.find(b"\n")
            if end >= 0:
                return held[:end].decode("utf-8", "replace")
            if len(held) > _FIRST_LINE:
                return None
        return held.decode("utf-8", "replace")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                line = pa.array([first_line(path)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in (0, 1)), line], ["path", "length", "line"])

    spread = dealt(files.select("path", "length"), "path")
    told = spread.mapInArrow(look, "path string, length long, line string")
    alone = F.coalesce(V.is_one_value(F.col("line")), F.lit(False))
    return materialise(told.select("path", "length", alone.alias("records"), F.coalesce(F.col("line") == "", F.lit(False)).alias("blank")))


def records(files: DataFrame) -> DataFrame:
    """(path, text) of the lines of files (path, length) that are not blank, named so that they sort as they stand."""
    ship_package(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, texts, size = [], [], 0
                for at, line in _lines(row["path"], row["start"], row["stop"]):
                    if line.strip(_BLANK):
                        names.append(f"{row['document']}#{at:020d}")
                        texts.append(line.decode("utf-8", "replace"))
                        size += len(line)
                    if size > _BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["path", "text"])
                        names, texts, size = [], [], 0
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["path", "text"])

    whole = files.select(F.col("path").alias("document"), "path", F.lit(0).cast("long").alias("base"), "length")
    return _splits(whole).mapInArrow(read, "path string, text string")


def _placed(files: DataFrame) -> DataFrame:
    """The splits of documents with the state and depth they begin in; those of documents that are no object are left out."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                lead: list[bytes] = []

                def noted(blocks: Iterator[bytes]) -> Iterator[bytes]:
                    for block in blocks:
                        if not lead and block.strip(_BLANK):
                            lead.append(block.strip(_BLANK)[:1])
                        yield block

                lanes = outcomes(noted(_blocks(row["path"], row["start"], row["stop"])))
                ends, depths = ([lane[k] for lane in lanes] for k in (0, 1))
                columns = [pa.array([ends], pa.list_(pa.int32())), pa.array([depths], pa.list_(pa.int64())), pa.array(lead or [None], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *columns], [*batch.schema.names, "ends", "depths", "lead"])

    told = materialise(_splits(files).mapInArrow(tell, f"{_SPLITS}, ends array<int>, depths array<long>, lead binary"))
    # As many entries as the document has splits; no bytes of it.
    along = F.array_sort(F.collect_list(F.struct(
        (F.col("base") + F.col("start")).alias("split"), "path", "base", "start", "stop", "ends", "depths", "lead"
    )))
    composed = told.groupBy("document").agg(along.alias("splits")).selectExpr(
        "document",
        """aggregate(splits, named_struct('state', 0, 'depth', 0L, 'object', cast(null as boolean),
             'out', cast(array() as array<struct<split: bigint, path: string, base: bigint, start: bigint, stop: bigint, state: int, depth: bigint>>)),
           (a, s) -> named_struct(
             'state', element_at(s.ends, a.state + 1), 'depth', a.depth + element_at(s.depths, a.state + 1),
             'object', coalesce(a.object, s.lead = X'7B'),
             'out', array_append(a.out, named_struct('split', s.split, 'path', s.path, 'base', s.base, 'start', s.start, 'stop', s.stop,
               'state', a.state, 'depth', a.depth)))) AS told""",
    )
    return composed.filter("told.object").select("document", F.explode("told.out").alias("s")).select("document", "s.*")


def _concatenated(pieces: Column) -> Column:
    """Binary pieces, structs of (at, piece), one after the other."""
    ordered = F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p["piece"])
    return F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p))


def documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skeletons, elements) of documents given as files (document, path, base, length).

    skeletons has document and text: the JSON without the elements of its members, each member that is an array or object holding only
    its number instead (an object under that number as key). elements has document, container (that number), at (its place) and text:
    a value, or a key and a value. A document that is no JSON object has a skeleton that is none either.
    """
    ship_package(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                pieces = cut(_blocks(row["path"], row["start"], row["stop"]), row["state"], row["depth"], row["split"])
                for piece in pieces:
                    held.append((row["document"], row["split"], *piece))
                    size += len(piece[-1] or b"")
                    if size > _BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)

    placed = materialise(_placed(files))
    spread = dealt(placed.select("document", "path", "split", "start", "stop", "state", "depth"), "document", "split")
    pieces = materialise(spread.mapInArrow(read, _PIECES))

    last = F.encode(F.substring(F.col("piece").cast("string"), -1, 1), "utf-8")
    number = F.col("container").cast("string")
    held = F.when(F.col("container").isNull(), "").when(last == F.lit(b"{"), F.concat(F.lit('"'), number, F.lit('":'), number)).otherwise(number)
    bones = pieces.filter(F.col("kind") == _SKELETON).select("document", "at", F.concat("piece", F.encode(held, "utf-8")).alias("piece"))
    skeletons = bones.groupBy("document").agg(_concatenated(F.struct("at", "piece")).cast("string").alias("text"))
    every = files.select("document").distinct()
    skeletons = every.join(skeletons, "document", "left").select("document", F.coalesce("text", F.lit("")).alias("text"))

    # A split that begins inside a member goes on with the one opened last before it. One row per split.
    opened = pieces.filter(F.col("kind") == _LAST_OPENED).select("document", "split", F.col("container").alias("opened"))
    before = Window.partitionBy("document").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.select("document", "split").join(opened, ["document", "split"], "left").select(
        "document", "split", F.last("opened", ignorenulls=True).over(before).alias("carried")
    )
    parts = pieces.filter(F.col("kind") == _ELEMENT).drop("kind")
    inner = F.col("starts") & (F.col("ends") != _GOES_ON)
    whole = parts.filter(inner)
    # At most two pieces of a split belong to elements that go on in others.
    along = Window.partitionBy("document").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(along)
    torn = parts.filter(~inner).withColumn("begun", begun).groupBy("document", F.col("begun").alias("at")).agg(
        F.min_by("split", "at").alias("split"), F.min_by("container", "at").alias("container"),
        F.min_by("first", "at").alias("first"), F.max("ends").alias("ends"), _concatenated(F.struct("at", "piece")).alias("piece"),
    )
    columns = ["document", "split", "at", "container", "first", "ends", "piece"]
    # A row per split that begins inside a member: pieces of documents are not exchanged for them.
    carried = F.broadcast(carried.filter(F.col("carried").isNotNull()))
    found = whole.select(*columns).unionByName(torn.select(*columns)).join(carried, ["document", "split"], "left")
    text = F.btrim(F.col("piece").cast("string"), F.lit(" \t\r\n"))
    elements = found.select("document", F.coalesce("container", "carried").alias("container"), "at", text.alias("text"), "first", "ends")
    # Nothing between the brackets is no element.
    return skeletons, elements.filter(~((F.col("text") == "") & F.col("first") & (F.col("ends") == _CLOSED))).drop("first", "ends")
