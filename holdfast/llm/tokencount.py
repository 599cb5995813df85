"""Token counts of a merge-by-score piece model (sentencepiece BPE with byte fallback) by a finite-state transducer.

The last token of the encoding of a prefix follows from the last tokens of shorter prefixes: it is the one piece that
ends there, is its own encoding, and stands next to the token before it when the two are encoded together. A state is
the set of starts from which a longer piece may still end later: (node in the trie of pieces, last token before that
start, count up to that start less the count up to here). Transitions carry the change of the count. States and
transitions are compiled when first met and kept up to a limit, then compiling starts anew, so memory is bounded.

No piece joins a character to a word mark behind it, so every word mark after another character brings the transducer
into its start state. A text may therefore be cut anywhere: the map of a chunk (from the state before it to the state
after it, with a count) is given by its part before the first such mark, the count of its middle, and its part from the
last such mark on. These maps compose associatively; the maps of the chunks of a long text are made by different tasks
and folded in the order of the chunks.

Defined results: a null text counts like an empty one, 0 tokens; repeated rows are counted each; extra columns are
ignored; an empty table gives no rows. Texts that hold the strings of control pieces treat them as ordinary text.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK_CHARS = 65_536
MAX_TRANSITIONS = 800_000
MAX_PAIRS = 500_000
MAX_WORDS = 700_000

_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_STARTS = re.compile(f"(?<=[^{MARK}]){MARK}")


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalisation, a dummy prefix and byte fallback")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if model.trainer_spec.model_type != 2 or any(MARK in p.lstrip(MARK) for p in self.score) or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only merge models whose pieces have word marks at their start alone, without user symbols")
        self.nodes: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.score:
            at = 0
            for c in p:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.piece.append(None)
                at = self.nodes[at][c]
            self.piece[at] = p
        self.clear()
        self.words: dict[str, int] = {}
        self.beside: dict[tuple[str, str], bool] = {}

    def clear(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.size = 0
        self.start = self.transitions(((0, "", 0),))

    def transitions(self, state: tuple) -> dict:
        """Of a state: character -> (transitions of the next state, change of the count); None -> the state itself."""
        own = self.states.get(state)
        if own is None:
            own = self.states[state] = {None: state}
        return own

    def merge(self, text: str) -> list[str]:
        """The encoding by its definition, for a token or two: always the best merge, the leftmost of equals."""
        parts, score, never = list(text), self.score.get, -np.inf
        gains = [score(a + b, never) for a, b in itertools.pairwise(parts)]
        while gains and (best := max(gains)) > never:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], never)
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], never)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        key = (before, piece)
        if key not in self.beside:
            if len(self.beside) >= MAX_PAIRS:
                self.beside.clear()
            self.beside[key] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return self.beside[key]

    def compile(self, at: dict, c: str) -> tuple[dict, int]:
        """The transition of a state by a character."""
        here = at[None]
        if self.size >= MAX_TRANSITIONS:
            self.clear()
            at = self.transitions(here)
        found, alive, nodes = None, [], self.nodes
        for node, before, count in here:
            longer = nodes[node].get(c)
            if longer is None:
                continue
            if nodes[longer]:
                alive.append((longer, before, count))
            if found is None and (p := self.piece[longer]) is not None and self.fits(before, p):
                found = (p, count + 1)
        if found is None:  # no piece ends with it: its bytes
            found = (c, len(c.encode("utf-8", "surrogatepass")))
        token, change = found
        step = (self.transitions((*((n, b, k - change) for n, b, k in alive), (0, token, 0))), change)
        at[c] = step
        self.size += 1
        return step

    def count(self, word: str) -> int:
        """Tokens of what stands from one start state to the next."""
        at, total = self.start, 0
        for c in word:
            try:
                at, change = at[c]
            except KeyError:
                at, change = self.compile(at, c)
            total += change
        return total

    def of(self, word: str) -> int:
        """Tokens of a word behind one word mark."""
        n = self.words.get(word)
        if n is None:
            n = self.count(MARK + word)
            if len(self.words) < MAX_WORDS:
                self.words[word] = n
        return n

    def tokens(self, text: str | None) -> int:
        return self.plain(text) if text else 0

    def plain(self, text: str) -> int:
        """Tokens of a text from the start state on, the dummy prefix not yet set."""
        if text[0] == " " or text[-1] == " " or "  " in text or MARK in text:
            return self.whole(MARK + text.replace(" ", MARK))
        parts, get = text.split(" "), self.words.get
        counts = [get(w) for w in parts]
        if None in counts:
            counts = [self.of(w) if n is None else n for w, n in zip(parts, counts, strict=True)]
        return sum(counts)

    def whole(self, marked: str) -> int:
        """Tokens from the start state; ``marked`` begins where a start state is."""
        return sum(self.of(w[1:]) if w[0] == MARK and w[1:2] != MARK else self.count(w) for w in _WORDS.findall(marked))

    def chunk(self, marked: str) -> tuple[str, int | None, str]:
        """The map of a chunk: (head, count of the middle, tail); (chunk, None, "") if no start state is inside."""
        starts = [m.start() for m in _STARTS.finditer(marked)]
        if not starts:
            return marked, None, ""
        return marked[: starts[0]], self.whole(marked[starts[0] : starts[-1]]), marked[starts[-1] :]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of two neighbouring chunks; associative."""
        if a[1] is not None and b[1] is not None:
            return a[0], a[1] + self.whole(a[2] + b[0]) + b[1], b[2]
        head, middle, tail = self.chunk(a[0] + b[0] if a[1] is None else a[2] + b[0])
        if a[1] is None and b[1] is None:
            return head, middle, tail
        if a[1] is None:
            return (head, b[1], b[2]) if middle is None else (head, middle + self.whole(tail) + b[1], b[2])
        return (a[0], a[1], head) if middle is None else (a[0], a[1] + self.whole(head) + middle, tail)

    def total(self, maps: list[tuple[str, int | None, str]]) -> int:
        head, middle, tail = functools.reduce(self.compose, maps)
        return self.whole(head) + (middle or 0) + self.whole(tail)


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer_of(path: str) -> Transducer:
    """Compiled once in each Python worker."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    long = F.col("size") > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer_of(path)
        for b in batches:
            n = pa.array([t.tokens(x.as_py()) for x in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), n], ["doc_id", "size", "n_tokens"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, names = transducer_of(path), ["row", "doc_id", "size", "chunk"]
        for b in batches:
            marked = (MARK * (k == 0) + x.as_py().replace(" ", MARK) for k, x in zip(b.column("chunk").to_pylist(), b.column("part"), strict=True))
            found = list(zip(*(t.chunk(m) for m in marked), strict=True)) or [(), (), ()]
            arrays = [pa.array(f, k) for f, k in zip(found, (pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + arrays, [*names, "head", "middle", "tail"])

    @F.pandas_udf("bigint")
    def total(heads: pd.Series, middles: pd.Series, tails: pd.Series) -> pd.Series:
        t = transducer_of(path)
        clean = lambda m: None if m is None or np.isnan(m) else int(m)
        return pd.Series([t.total([(h, clean(m), x) for h, m, x in zip(*own, strict=True)]) for own in zip(heads, middles, tails, strict=True)])

    done = rows.where(~long).mapInArrow(whole, f"doc_id {kind}, size bigint, n_tokens bigint")
    chunks = (
        rows.where(long)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.char_length("text") - 1) / chunk_chars).cast("int"))))
        .withColumn("part", F.substring("text", F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars)))
        .select("row", "doc_id", "size", "chunk", "part")
        .repartition("row", "chunk")
        .mapInArrow(maps, f"row bigint, doc_id {kind}, size bigint, chunk int, head string, middle bigint, tail string")
    )
    folded = (
        chunks.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("chunk", "head", "middle", "tail"))).alias("maps"))
        .select("doc_id", "size", total("maps.head", "maps.middle", "maps.tail").alias("n_tokens"))
    )
    return done.unionAll(folded).select("doc_id", F.col("size").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
