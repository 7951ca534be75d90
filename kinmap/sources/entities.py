"""Entity files: one JSON object of any size, read by byte ranges and written in parts.

The form is `{..., "entities": {"<id>": {"src": [..], "tgt": [..]}, ...}, ...}`, with
any white space and any other members. Where a byte range starts inside such an
object cannot be told from its own bytes, so it is read in steps:

1. Each range is summed up by what it does to a reader that enters it outside a
   string, inside one or behind a backslash: the state it is left in, how far the
   depth of brackets moves, and how low it gets. Such sums compose, so a row a range
   gives every range the state and the depth it is entered with.
2. The ranges that touch the top of the object, as a rule the first and the last,
   are searched for where the member `entities` opens and closes.
3. Each range yields the entities whose key starts in it, and reads on past its end
   until the last of them is whole.

A task holds a range and an entity, never a file, and a range that runs again gives
the same rows. Spark lists the files; local and mounted paths are opened as files,
others through pyarrow's file systems.

Defined results: a file without an object `entities` at its top is an error, as are a
file that ends inside an object, two such members, and an entity that is no object;
an empty object or a file of no bytes has no rows; a side that is missing, null or no list is empty; an id
that stands twice in a file gives the rows of both.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.session import checkpointed

RANGE_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
IDS_PER_PART = 1_000_000
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]]|"', re.DOTALL)
REST_OF_STRING = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
KEY_THEN_OBJECT = re.compile(rb'"entities"\s*:\s*\{')
BETWEEN = re.compile(r"[\s,]*")
COLON = re.compile(r"\s*:\s*")
Effect = list[tuple[int, int, int]]


def opened(path: str):
    if re.match(r"file:/|/", path):
        return open(re.sub(r"^file:/+", "/", path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def walked(data: bytes) -> Effect:
    """(state at the end, move of the depth, its lowest point) for entries outside and inside a string."""
    a = np.frombuffer(data, np.uint8)
    slash = a == 0x5C
    escaped = np.zeros(len(a), bool)
    if slash.any():
        # A byte is escaped when the run of backslashes before it is of odd length.
        place = np.arange(len(a))
        other = np.maximum.accumulate(np.where(slash, -1, place))
        escaped[1:] = (place[:-1] - other[:-1]) % 2 == 1
    odd = np.logical_xor.accumulate((a == 0x22) & ~escaped)
    step = ((a == 0x7B) | (a == 0x5B)).astype(np.int8) - ((a == 0x7D) | (a == 0x5D)).astype(np.int8)
    out = []
    for entry in (OUTSIDE, INSIDE):
        depth = np.cumsum(np.where(odd == bool(entry), step, 0), dtype=np.int64)
        end = int(odd[-1]) ^ entry
        if end == INSIDE and slash[-1] and not escaped[-1]:
            end = ESCAPED
        out.append((end, int(depth[-1]), min(0, int(depth.min()))))
    return out


def effect(data: bytes) -> Effect:
    """What the bytes do to a reader, for each of the three states it may come in."""
    if not data:
        return [(s, 0, 0) for s in (OUTSIDE, INSIDE, ESCAPED)]
    outside, inside = walked(data)
    if data[0] not in b'"\\':  # then the backslash before it changes nothing
        return [outside, inside, inside]
    return [outside, inside, walked(data[1:])[INSIDE] if len(data) > 1 else (INSIDE, 0, 0)]


def composed(first: Effect, then: Effect) -> Effect:
    out = []
    for state, move, low in first:
        end, more, lower = then[state]
        out.append((end, move + more, min(low, move + lower)))
    return out


class Part:
    """The bytes of a file from a place on; more are read when a token reaches past them."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start = file, start
        file.seek(start)
        self.data = file.read(size)

    def more(self) -> bool:
        self.file.seek(self.start + len(self.data))
        new = self.file.read(max(1 << 16, len(self.data)))
        self.data += new
        return bool(new)

    def tokens(self, state: int, end: int) -> Iterator[tuple[bytes, int]]:
        """(token, place) of whole strings and brackets that start before the end."""
        at = 0
        if state != OUTSIDE:
            rest = REST_OF_STRING.match(self.data, 1 if state == ESCAPED else 0)
            if rest is None:
                return
            at = rest.end()
        while True:
            found = TOKEN.search(self.data, at)
            if found is None or self.start + found.start() >= end:
                return
            if found.group() == b'"':
                at = found.start()
                if not self.more():
                    raise ValueError("a file of entities ends inside a string")
                continue
            at = found.end()
            yield found.group(), self.start + found.start()


def marks(file, start: int, end: int, state: int, depth: int) -> tuple[list[int], list[int]]:
    """Where an object `entities` at the top opens, and the first places that return to the top, in all and behind each opening."""
    part, opens, closes, wanted = Part(file, start, end - start), [], [], True
    for token, place in part.tokens(state, end):
        if token in (b"{", b"["):
            depth += 1
        elif token in (b"}", b"]"):
            depth -= 1
            if depth == 1 and wanted:
                closes.append(place)
                wanted = False
        elif depth == 1 and token == b'"entities"':
            at = place - start
            while re.fullmatch(rb"\s*:?\s*", part.data[at + len(token) :]) and part.more():
                pass
            found = KEY_THEN_OBJECT.match(part.data, at)
            if found:
                opens.append(start + found.end())
                wanted = True
    return opens, closes


def entities_in(file, start: int, end: int, state: int, depth: int, first: int, last: int) -> Iterator[tuple[int, str, list, list]]:
    """(place, id, src, tgt) of the entities whose key starts in the range; [first, last) is the inside of `entities`."""
    if last <= start or end <= first:
        return
    end = min(end, last)
    if start <= first:
        part, at = Part(file, first, end - first), 0
    else:
        part, at = Part(file, start, end - start), None
        for token, place in part.tokens(state, end):
            if token in (b"{", b"["):
                depth += 1
            elif token in (b"}", b"]"):
                depth -= 1
            elif depth == 2:
                at = place - start
                break
        if at is None:
            return
    base, decode = part.start, json.JSONDecoder().raw_decode
    text = part.data.decode("latin-1")  # a character a byte; ids are decoded from their bytes

    def whole(place: int) -> tuple[object, int]:
        nonlocal text
        while True:
            try:
                return decode(text, place)
            except json.JSONDecodeError:
                if base + len(text) > last or not part.more():
                    raise ValueError("no JSON in a file of entities") from None
                text = part.data.decode("latin-1")

    while True:
        at = BETWEEN.match(text, at).end()
        if base + at >= end:
            return
        key, after = whole(at)
        while (colon := COLON.match(text, after)) is None or colon.end() == len(text):
            if (colon is None and text[after:].strip()) or not part.more():
                raise ValueError("a member of entities without a value")
            text = part.data.decode("latin-1")
        sides, behind = whole(colon.end())
        if not isinstance(key, str) or not isinstance(sides, dict):
            raise ValueError("a member of entities that is no object")
        lists = [v if isinstance(v, list) else [] for v in (sides.get("src"), sides.get("tgt"))]
        yield base + at, json.loads(text[at:after].encode("latin-1")), *lists
        at = behind


def file_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(file, start, stop) of all files under the path, hidden ones left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    return files.select("file", "length", starts.alias("start")).select("file", "start", F.least("length", F.col("start") + size).alias("stop"))


def read(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(file, place, eid, src, tgt) of every entity of the files; place is the byte at which its id starts."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                total = effect(b"")
                with opened(r.file) as file:
                    file.seek(r.start)
                    for at in range(r.start, r.stop, BLOCK_BYTES):
                        total = composed(total, effect(file.read(min(BLOCK_BYTES, r.stop - at))))
                yield pd.DataFrame([[r.file, r.start, r.stop, *np.ravel(total).tolist()]], columns=names)

    def entered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start", ignore_index=True)
        state, depth, rows = OUTSIDE, 0, []
        for row in frame[names].itertuples(index=False):
            file, start, stop, *flat = row
            end, move, low = np.reshape(flat, (3, 3)).tolist()[state]
            rows.append((file, start, stop, state, depth, depth + low <= 1))
            state, depth = end, depth + move
        if state != OUTSIDE or depth != 0:
            raise ValueError(f"{frame.file.iloc[0]} ends inside an object")
        return pd.DataFrame(rows, columns=["file", "start", "stop", "state", "depth", "top"])

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                with opened(r.file) as file:
                    yield pd.DataFrame([(r.file, *marks(file, r.start, r.stop, r.state, r.depth))], columns=["file", "opens", "closes"])

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                held = []
                with opened(r.file) as file:
                    for row in entities_in(file, r.start, r.stop, r.state, r.depth, r.first, r.last):
                        held.append((r.file, *row))
                        if len(held) == 1000:
                            yield pd.DataFrame(held, columns=["file", "place", "eid", "src", "tgt"])
                            held = []
                yield pd.DataFrame(held, columns=["file", "place", "eid", "src", "tgt"])

    names = ["file", "start", "stop", *[f"{what}{s}" for s in range(3) for what in ("state", "move", "low")]]
    ranges = file_ranges(spark, path, size)
    count = max(1, ranges.count())
    sums = ranges.repartition(count).mapInPandas(summed, "file string, " + ", ".join(f"{n} long" for n in names[1:]))
    entry = checkpointed(sums.groupBy("file").applyInPandas(entered, "file string, start long, stop long, state int, depth long, top boolean"))
    top = entry.where("top OR depth <= 1").repartition(count).mapInPandas(bounds, "file string, opens array<long>, closes array<long>")
    both = top.groupBy("file").agg(F.flatten(F.collect_list("opens")).alias("opens"), F.flatten(F.collect_list("closes")).alias("closes"))
    checked = F.when(F.size("opens") == 1, F.col("opens")[0]).otherwise(F.raise_error(F.concat(F.lit("no or several objects named entities in "), F.col("file"))))
    inner = both.select("file", checked.alias("first"), "closes").select("file", "first", F.array_min(F.filter("closes", lambda c: c >= F.col("first"))).alias("last"))
    dealt = entry.join(inner, "file").repartition(count)
    return dealt.mapInPandas(found, "file string, place long, eid string, src array<long>, tgt array<long>")


def write(entities: DataFrame, ids: DataFrame, folder: str, *keys: str, ids_per_part: int = IDS_PER_PART) -> None:
    """Files of the form for each value of the keys, a folder a key and a part; ids without members have empty sides, null ids are left out."""
    ids = ids.where("eid IS NOT NULL")
    parts = max(1, -(-ids.count() // ids_per_part))
    lists = entities.groupBy(*keys, "eid").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "src", F.col("node")))).alias("src"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "tgt", F.col("node")))).alias("tgt"),
    )
    none = F.array().cast("array<bigint>")
    full = ids.select(*keys, "eid").join(lists, [*keys, "eid"], "left").withColumn("part", F.pmod(F.xxhash64("eid"), F.lit(parts)))
    group = Window.partitionBy(*keys, "part").orderBy("eid")
    named = F.to_json(F.struct(F.col("eid").alias("k")))
    line = F.concat(
        F.when(F.row_number().over(group) == 1, '{"entities": {').otherwise(","),
        named.substr(F.lit(6), F.length(named) - 6), F.lit(": "),
        F.to_json(F.struct(F.coalesce("src", none).alias("src"), F.coalesce("tgt", none).alias("tgt"))),
        F.when(F.lead(F.lit(1)).over(group).isNull(), "}}").otherwise(""),
    )
    lines = full.select(*keys, "part", line.alias("value"), F.row_number().over(group).alias("n"))
    lines.sortWithinPartitions(*keys, "part", "n").drop("n").write.mode("overwrite").partitionBy(*keys, "part").text(folder)
