"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's file:

* the splitter works on character classes (letter, number, white space, other),
  which are taken from the tokenizer's own splitting of every code point, and marks
  where a piece of text starts that is tokenized by itself. A mark depends on a few
  characters around it;
* the counter works on the bytes of a piece. Its state is what the tokenizer's
  merges can still change: the longest suffix that begins some token, and for
  each place in it the last token of the best tokenization that ends there, with
  the count so far relative to now. A transition adds the difference of counts,
  so the sum over a piece is its number of tokens. States and transitions are
  compiled when first met and kept by the worker.

Long texts are cut into chunks, each a row of its own with some characters before
and after it. A chunk's state map says in which state it is entered, in which it is
left and how many tokens it emits between. Where the piece at its border starts
among the characters before it, or no piece hangs over the border, the entering
state is certain. Else it is the one that a run over these characters gives, and
the map holds if the chunk before leaves that state: maps compose where their
states meet. A scan over the chunks' maps, which hold states and counts and no
text, checks that and adds the counts up; chunks that were entered in another state
are mapped anew from it, until all maps meet.

Defined results: null is the empty text with 0 bytes and 0 tokens; special
strings count as one token wherever they stand; repeated rows are counted each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.llm.text import PAD, blocks, bounded, span_hashes, tidy
from kinmap.session import checkpointed

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK_CHARS = 1 << 16
#: Characters that a chunk takes along on each side; a mark between pieces depends on less than SURE of them.
CONTEXT, SURE = 64, 8
LONG_SPAN = 2048
CACHE_STATES = 400_000

LETTER, NUMBER, SPACE, BLANK, OTHER = range(5)  # BLANK is U+0020, SPACE all other white space


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def class_ranges(path: str) -> tuple[bytes, bytes]:
    """Where runs of code points of one class start, and their classes, as the tokenizer's own splitter has them.

    The classes of another Unicode version are the first guess. The splitter keeps a
    run of one class together, so it is asked to split all characters of a guessed
    class in a row, and asked again for the pieces that this falls into.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        kinds[[ord(c) for c in regex.findall(pattern, "".join(map(chr, points)))]] = kind

    def asked(c: str) -> int:
        """A character is of the class whose runs it carries on."""
        for kind, mark in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(split(mark + c)) == 1:
                return kind
        return SPACE

    for kind in (LETTER, NUMBER, SPACE, OTHER):
        row = "".join(chr(c) for c in points if kinds[c] == kind)
        pieces = split(row)
        for _, (start, end) in pieces if len(pieces) > 1 else ():
            ends = {asked(row[k]) for k in (start, end - 1)}
            for c in row[start:end]:  # a piece is of one class, but for a blank before it or a contraction
                kinds[ord(c)] = min(ends) if len(ends) == 1 else asked(c)
    kinds[0x20] = BLANK
    start = np.flatnonzero(np.diff(kinds, prepend=255))
    return start.astype("<u4").tobytes(), kinds[start].tobytes()


@lru_cache(maxsize=2)
def character_classes(ranges: tuple[bytes, bytes]) -> np.ndarray:
    """Class of every code point."""
    start = np.frombuffer(ranges[0], "<u4").astype(np.int64)
    return np.repeat(np.frombuffer(ranges[1], np.uint8), np.diff(np.append(start, 0x110000)))


class Counter:
    """The counting transducer of a byte-level BPE vocabulary."""

    def __init__(self, path: str, ranges: tuple[bytes, bytes]):
        self.classes = character_classes(ranges)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # Of special strings that start at the same place the longest counts.
        special = sorted((a["content"] for a in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = special
        self.specials = re.compile("|".join(map(re.escape, special))) if special else None
        #: Beyond so many characters from where a text is cut, marks between pieces are certain.
        self.sure = SURE + max(map(len, special), default=0)
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), k in self.rank.items():
            self.made.setdefault(a + b, (k, a, b))
        self.tokens = set(self.made) | {bytes([b]) for b in range(256)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((None, 0),))
        self.ids, self.states = {start: 0}, [start]
        self.keys, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.moves: dict[int, int] = {}

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The token's outermost parts on one side, each with the rank at which it is consumed."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until, *parts = self.made[token]
            token = parts[side]

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave the border between two adjacent tokens alone.

        A part at the border lives until its own token's next merge. A merge over
        the border happens when it ranks before both parts are consumed; of equal
        ranks the merge further left comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            rights = self.spine(right, 0)
            known = True
            for a, a_until in self.spine(left, 1):
                for b, b_until in rights:
                    k = self.rank.get((a, b))
                    if k is not None and k < a_until and k <= b_until:
                        known = False
            self.pairs[left, right] = known
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """Next state and the change of the count."""
        suffix, ends = state
        grown = suffix + bytes([byte])
        for k in range(len(grown)):
            token = grown[k:]
            if token in self.tokens and (ends[k][0] is None or self.stays(ends[k][0], token)):
                break
        now = ends[k][1] + 1
        cut = 0
        while grown[cut:] not in self.prefixes:
            cut += 1
        after = [(t, n - now) for t, n in ends[cut:]] + [(token, 0)]
        if cut == len(grown):
            after = [(token, 0)]
        return (grown[cut:], tuple(after)), now

    def counts(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span, all spans run through the transducer in step."""
        if len(self.states) > CACHE_STATES:
            self.reset()
        order = np.argsort(starts - ends, kind="stable")  # longest first: the active spans are a prefix
        starts, lengths = starts[order], (ends - starts)[order]
        state, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        # The few spans that are longer than the others by far are not worth a vector's step a byte.
        alone = int(np.searchsorted(-lengths, -LONG_SPAN, "left"))
        for k in range(alone):
            state[k], count[k] = self.run(padded[starts[k] : starts[k] + lengths[k]].tobytes())
        longest = int(lengths[alone]) if alone < len(lengths) else 0
        starts, lengths, order_of_rest = starts[alone:], lengths[alone:], slice(alone, None)
        state, among = state[order_of_rest], count[order_of_rest]
        for k in range(longest):
            live = int(np.searchsorted(-lengths, -k, "left"))
            key = state[:live] << 8 | padded[starts[:live] + k]
            place = np.searchsorted(self.keys, key)
            found = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(live, bool)
            if not found.all():
                self.compile(np.unique(key[~found]))
                place = np.searchsorted(self.keys, key)
            value = self.values[place]
            state[:live] = value >> 8
            among[:live] += (value & 255) - 128
        out = np.empty_like(count)
        out[order] = count
        return out

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """The state after the bytes, from a state on, and the tokens they add."""
        count = 0
        for byte in data:
            key = state << 8 | byte
            value = self.moves.get(key)
            if value is None:
                place = np.searchsorted(self.keys, key)
                if place == len(self.keys) or self.keys[place] != key:
                    self.compile(np.array([key]))
                    place = np.searchsorted(self.keys, key)
                value = self.moves[key] = int(self.values[place])
            state = value >> 8
            count += (value & 255) - 128
        return state, count

    def named(self, state: int) -> str:
        """A state as text that every worker understands."""
        suffix, ends = self.states[state]
        return json.dumps([suffix.hex(), [[None if t is None else t.hex(), n] for t, n in ends]])

    def numbered(self, name: str) -> int:
        suffix, ends = json.loads(name)
        state = bytes.fromhex(suffix), tuple((None if t is None else bytes.fromhex(t), n) for t, n in ends)
        at = self.ids.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
        return at

    def compile(self, keys: np.ndarray) -> None:
        values = []
        for key in keys.tolist():
            after, change = self.step(self.states[key >> 8], key & 255)
            at = self.ids.setdefault(after, len(self.states))
            if at == len(self.states):
                self.states.append(after)
            values.append(at << 8 | change + 128)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.values = np.insert(self.values, place, values)


@lru_cache(maxsize=2)
def counter(path: str, ranges: tuple[bytes, bytes]) -> Counter:
    return Counter(path, ranges)


def code_points(padded: np.ndarray, size: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and class of each character of valid UTF-8."""
    data = padded[:size]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = padded[at].astype(np.int32)
    if size and data.max() < 0x80:
        return at, classes[lead]
    b1, b2, b3 = (padded[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
    point = np.where(lead < 0x80, lead, (lead & 0x1F) << 6 | b1)
    point = np.where(lead >= 0xE0, (lead & 0x0F) << 12 | b1 << 6 | b2, point)
    point = np.where(lead >= 0xF0, (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3, point)
    return at, classes[point]


def piece_starts(padded: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and rows of the pieces of the rows."""
    size = int(offsets[-1])
    at, kind = code_points(padded, size, classes)
    n = len(at)
    if not n:
        return at, at, at
    first = np.zeros(n, bool)  # of its row
    first[np.searchsorted(at, offsets[(offsets < size)])] = True
    last = np.append(first[1:], True)
    white = (kind == BLANK) | (kind == SPACE)
    before = np.append(OTHER, kind[:-1])
    before_white = np.append(False, white[:-1])
    after_white = np.append(white[1:], True)
    same = (kind == before) & ~white & ~first
    # A blank right before anything else joins it; other white space stays with white space,
    # but for the last of a run that something follows.
    joins = ~white & (before == BLANK) & ~first
    lone = white & before_white & ~first & ~(~last & ~after_white)
    begin = first | ~(same | joins | lone)
    # An apostrophe that starts a piece takes s, d, m, t, ll, ve or re with it.
    quote = np.flatnonzero(begin & (padded[at] == 0x27))
    if len(quote):
        row = np.searchsorted(offsets, at[quote], "right")
        room = offsets[row] - at[quote]
        b1, b2 = padded[at[quote] + 1], padded[at[quote] + 2]
        two = (room >= 3) & (((b1 == 0x6C) & (b2 == 0x6C)) | ((b1 == 0x76) & (b2 == 0x65)) | ((b1 == 0x72) & (b2 == 0x65)))
        one = (room >= 2) & np.isin(b1, np.frombuffer(b"sdmt", np.uint8))
        begin[quote[one | two] + 1] = False
        begin[quote[two] + 2] = False
        for wide, hit in ((2, one & ~two), (3, two)):
            follow = quote[hit] + wide
            follow = follow[follow < n]
            begin[follow] = True
    starts = at[begin]
    ends = np.append(starts[1:], size)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def counted_rows(texts: pa.Array, machine: Counter) -> np.ndarray:
    """Number of tokens of each text without special strings."""
    out = np.zeros(len(texts), np.int64)
    for row, last, padded, offsets in blocks(texts):
        starts, ends, rows = piece_starts(padded, offsets, machine.classes)
        if not len(starts):
            continue
        _, index, inverse = np.unique(span_hashes(padded, starts, ends), return_index=True, return_inverse=True)
        tokens = machine.counts(padded, starts[index], ends[index])
        out[row:last] += np.bincount(rows, weights=tokens[inverse], minlength=last - row).astype(np.int64)
    return out


def count_texts(texts: pa.Array, machine: Counter) -> np.ndarray:
    """As counted_rows, with special strings taken out first, which count as one token each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    held = np.zeros(len(texts), bool)
    for special in machine.special:
        held |= pa.compute.match_substring(texts, special).to_numpy(zero_copy_only=False)
    if not held.any():
        return counted_rows(texts, machine)
    rest = pa.compute.if_else(pa.array(held), pa.scalar("", pa.large_string()), texts)
    out = counted_rows(rest, machine)
    for k in np.flatnonzero(held).tolist():
        parts = machine.specials.split(texts[k].as_py())
        out[k] = len(parts) - 1 + int(counted_rows(pa.array(parts, pa.large_string()), machine).sum())
    return out


def chunk_map(machine: Counter, before: str, text: str, after: str, whole: bool, entered: str | None) -> tuple[str | None, str | None, int]:
    """(state in which the chunk is entered, state in which it is left, tokens that it emits).

    The first is null where it is certain; the second where a piece ends with the
    chunk. `before` reaches the text's start if `whole`. `entered` is the state to
    enter in, if it is known.
    """
    here = before + text + after
    low = len(before.encode())
    high = low + len(text.encode())
    cuts, at = [], 0  # parts of the text between special strings, by bytes
    n = 0
    for m in machine.specials.finditer(here) if machine.specials else ():
        start = len(here[: m.start()].encode())
        cuts.append((at, start))
        at = start + len(m.group().encode())
        n += low <= start < high
    data = here.encode()
    cuts.append((at, len(data)))
    padded = np.zeros(len(data) + PAD, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    entry = left = None
    for a, b in cuts:
        if b <= low or a >= high or a == b:
            continue
        part = np.zeros(b - a + PAD, np.uint8)
        part[: b - a] = padded[a:b]
        starts, ends, _ = piece_starts(part, np.array([0, b - a]), machine.classes)
        starts, ends = starts + a, ends + a
        inside = (starts >= low) & (ends <= high)
        n += int(machine.counts(padded, starts[inside], ends[inside]).sum())
        for s, e in zip(starts[~inside].tolist(), ends[~inside].tolist()):
            if e <= low or s >= high:
                continue
            state = 0
            if s < low:
                # A piece that seems to start with the characters before may start earlier.
                certain = whole or a > 0 or np.count_nonzero((padded[:s] & 0xC0) != 0x80) >= machine.sure
                state, _ = machine.run(data[s:low])
                if not certain:
                    state = machine.numbered(entered) if entered else state
                    entry = machine.named(state)
            state, more = machine.run(data[max(s, low) : min(e, high)], state)
            n += more
            if e > high:
                left = machine.named(state)
    return entry, left, n


KEYS = ["doc_id", "n_bytes", "digest"]


def counted_long(long: DataFrame, path: str, ranges: tuple[bytes, bytes], chunk_chars: int, context: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of long texts, chunk by chunk."""
    rows = long.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("digest"), "text", "chars")
    start = F.col("chunk") * chunk_chars
    reach = F.least(start, F.lit(context))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("chars") - 1) / chunk_chars).cast("int")))).select(
        *KEYS,
        "chunk",
        F.substring("text", start - reach + 1, reach).alias("before"),
        F.substring("text", start + 1, F.lit(chunk_chars)).alias("text"),
        F.substring("text", start + chunk_chars + 1, F.lit(context)).alias("after"),
        (start <= context).alias("whole"),
    )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path, ranges)
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("before", "text", "after", "whole", "entered")))
            maps = [chunk_map(machine, *g) for g in given]
            entry, left, n = zip(*maps) if maps else ((), (), ())
            arrays = [pa.array(list(entry), pa.string()), pa.array(list(left), pa.string()), pa.array(list(n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*KEYS, "chunk")], *arrays], [*KEYS, "chunk", "entry", "left", "n"])

    schema = "doc_id long, n_bytes long, digest string, chunk int, entry string, left string, n long"
    maps = chunks.withColumn("entered", F.lit(None).cast("string")).mapInArrow(tidy(mapped), schema)
    # Equal rows of one id have equal maps; how often they stand is told by their first chunks.
    maps = checkpointed(maps.groupBy(*KEYS, "chunk", "entry", "left", "n").agg(F.count("*").alias("copies")))
    by_text = Window.partitionBy(*KEYS).orderBy("chunk")
    while True:
        met = maps.withColumn("prior", F.lag("left").over(by_text))
        wrong = met.where("entry <> prior").select(*[F.col(c).alias(f"w_{c}") for c in (*KEYS, "chunk")], F.col("prior").alias("entered"))
        wrong = checkpointed(wrong)
        if wrong.isEmpty():
            break
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in (*KEYS, "chunk")])
        again = chunks.join(wrong, same).drop(*[f"w_{c}" for c in (*KEYS, "chunk")])
        again = again.mapInArrow(tidy(mapped), schema).groupBy(*KEYS, "chunk", "entry", "left", "n").agg(F.count("*").alias("copies"))
        maps = checkpointed(maps.join(wrong.drop("entered"), same, "left_anti").unionByName(again))
    totals = maps.groupBy(*KEYS).agg(F.sum("n").alias("n_tokens"), F.max("copies").alias("copies"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return totals.select("doc_id", "n_bytes", "n_tokens", each).drop("copy")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, context: int = CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = path or default_path()
    ranges = class_ranges(path)
    machine = counter(path, ranges)
    if context < machine.sure:
        raise ValueError(f"a chunk needs {machine.sure} characters before and after it at least")
    if any(a.endswith(b[:k]) for a in machine.special for b in machine.special for k in range(1, len(b))):
        chunk_chars = (1 << 31) - 1  # special strings that can overlap need all of a text
    text = F.coalesce("text", F.lit(""))
    rows = bounded(docs).select("doc_id", text.alias("text"), F.length(text).alias("chars"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path, ranges)  # the worker's own
        for batch in batches:
            counts = count_texts(batch.column("text"), machine)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    few = rows.where(F.col("chars") <= chunk_chars).select("doc_id", n_bytes, "text")
    few = few.mapInArrow(tidy(short), "doc_id long, n_bytes long, n_tokens long")
    many = counted_long(rows.where(F.col("chars") > chunk_chars), path, ranges, chunk_chars, context)
    return few.unionByName(many).select("*", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
