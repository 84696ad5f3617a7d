"""Byte-pair encoding with a tokenization automaton.

``compile_automaton`` makes a deterministic automaton over tokens whose paths are exactly the correct tokenizations.  It starts as one
state with a loop for each byte and is extended merge by merge.  The gadget for the merge (u, v) splits the state r that
arcs labelled u enter: a copy r' takes these arcs over and keeps r's own arcs except the one labelled v, and every state
with an arc u gains an arc uv to where r's arc v leads.  All arcs with one label enter one state, so a gadget adds one
state, and a state is known by the label that enters it and the gadgets so far.

The result is a set of transition arrays, made once on the driver and broadcast: the byte trie of the arc labels (for each node and byte the next
node and the label that ends there), and for the arcs that a state lost a table by state and label, with a default transition to the state's
origin (the state that the right part of its label enters) and of a label to its left part.  So a transition is a walk along two short
chains of defaults; each pair of labels is resolved once and kept.

A pre-split word is encoded by table-driven transitions: at a position, the byte trie of labels gives the arcs that match, the
longest is tried first, and as exactly one path reaches each position no position is visited twice.  Decoding emits the arc labels.

Texts are split as byte-level tokenizers do; added special tokens are cut out first and are ids of their own.  Null text is
the empty text with no tokens; rows keep their order, repeated rows give repeated results, an empty table gives no rows, other columns are ignored, whatever their names.
Texts and words of any length are encoded whole; the tables of words that a worker keeps only save time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, texts_of

#: Fixed value: the split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and pairs of labels, in each of the two tables that a worker keeps (the newer one takes the older one's place when it is full), and the longest such word.
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 125_000, 150_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tables(NamedTuple):
    """The automaton's transition arrays.  An id of no label has left, right and born -1."""

    left: np.ndarray  # of each token: its parts, and the gadget that made it
    right: np.ndarray
    born: np.ndarray
    lost: np.ndarray  # state's label << 20 | lost label, sorted
    gadget: np.ndarray  # the gadget in which it was lost
    step: np.ndarray  # node of the byte trie << 8 | byte, sorted
    to: np.ndarray  # next node
    label: np.ndarray  # the token that ends there, -1 for none


class Automaton:
    """Walks the transition arrays, as dictionaries."""

    def __init__(self, tables: Tables):
        self.left, self.right, self.born = (x.tolist() for x in tables[:3])
        self.gadget = dict(zip(tables.lost.tolist(), tables.gadget.tolist(), strict=True))
        self.step = dict(zip(tables.step.tolist(), zip(((tables.to.astype(np.int64)) << 8).tolist(), tables.label.tolist(), strict=True), strict=True))
        self.known: dict[int, bool] = {}  # answers of follows
        self.older: dict[int, bool] = {}

    def follows(self, u: int, t: int) -> bool:
        """Whether the state that arcs labelled u enter has an arc labelled t.

        That state is a copy of a copy: its newest gadgets split it under the label u, the older ones, from before u was made,
        under the right part of u, and so on.  A gadget took the arc t if it took what t was then: t itself if t had been made,
        else its left part, and so on, since an arc is only added to states that have that of the left part.
        """
        left, right, born, gadget = self.left, self.right, self.born, self.gadget
        before = 1 << 30
        while True:
            x, until, key = t, 1 << 30, u << 20
            while True:
                k = gadget.get(key | x)
                if k is not None and k < before and born[x] < k <= until:
                    return False
                until = born[x]
                if until < 0:
                    break
                x = left[x]
            before = born[u]
            if before < 0:
                return True
            u = right[u]

    def _pair(self, key: int, u: int, t: int) -> bool:
        ok = self.older.get(key)
        if ok is None:
            ok = self.follows(u, t)
        if len(self.known) >= KEPT_PAIRS:
            self.older, self.known = self.known, {}
        self.known[key] = ok
        return ok

    def encode(self, word: bytes) -> list[int]:
        """The one path whose labels spell the word.

        Longer labels are tried first.  As one path at most reaches a position, a position without a way on is dead for good.
        """
        n, step = len(word), self.step
        out: list[int] = []
        places, open_, dead = [0], [], set()
        at = 0
        while True:
            found, node, j = [], 0, at  # (end, token) of the labels that stand here, the longest last
            while j < n:
                arc = step.get(node | word[j])
                if arc is None:
                    break
                node, t = arc
                j += 1
                if t >= 0:
                    found.append((j, t))
            open_.append(found)
            while True:
                last = out[-1] << 20 if out else -1
                while found:
                    end, t = found.pop()
                    if end in dead:
                        continue
                    if last >= 0:
                        ok = self.known.get(last | t)
                        if ok is None:
                            ok = self._pair(last | t, out[-1], t)
                        if not ok:
                            continue
                    break
                else:
                    dead.add(places.pop())
                    open_.pop()
                    out.pop()
                    found = open_[-1]
                    continue
                break
            out.append(t)
            if end == n:
                return out
            places.append(end)
            at = end


def compile_automaton(byte_ids: list[int], merges: list[tuple[int, int, int]], labels: dict[int, bytes]) -> Tables:
    """The arrays for the ids of the single bytes, the merges as (left id, right id, merged id) in order, and each id's bytes."""
    none = np.empty(0, np.int64)
    blank = np.full(max(labels) + 1, -1, np.int32)
    auto = Automaton(Tables(blank, blank, blank, none, none, none, none, none))
    for k, (u, v, made) in enumerate(merges):
        if auto.follows(u, v):  # else no path holds u v, and the merge never applies
            auto.left[made], auto.right[made], auto.born[made] = u, v, k
            auto.gadget[u << 20 | v] = k
    nodes: dict[bytes, int] = {b"": 0}
    arcs: dict[int, list[int]] = {}
    for t in [*byte_ids, *(m[2] for m in merges if auto.born[m[2]] >= 0)]:
        text = labels[t]
        for k in range(len(text)):
            to = nodes.setdefault(text[: k + 1], len(nodes))
            arc = arcs.setdefault(nodes[text[:k]] << 8 | text[k], [to, -1])
        arc[1] = t
    lost, step = sorted(auto.gadget), sorted(arcs)
    return Tables(
        *(np.array(x, np.int32) for x in (auto.left, auto.right, auto.born)), np.array(lost, np.int64), np.array([auto.gadget[x] for x in lost], np.int32),
        np.array(step, np.int64), np.array([arcs[x][0] for x in step], np.int32), np.array([arcs[x][1] for x in step], np.int32),
    )


class Compiled(NamedTuple):
    """All that encoding and decoding need, by value: the arrays, the special tokens, and the label of each id."""

    tables: Tables
    special: dict[str, int]
    label: dict[int, bytes]


def compile_vocabulary(text: str) -> Compiled:
    """From the JSON text of a byte-level tokenizer."""
    spec = json.loads(text)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    letters = byte_letters()
    as_byte = {c: b for b, c in enumerate(letters)}
    labels = {i: bytes(map(as_byte.__getitem__, t)) for t, i in vocab.items() if all(c in as_byte for c in t)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    tables = compile_automaton([vocab[c] for c in letters if c in vocab], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], labels)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    return Compiled(tables, special, labels | {i: t.encode() for t, i in special.items()})


class Tokenizer:
    """A byte-level tokenizer, from its JSON text or what compile_vocabulary made of it."""

    def __init__(self, source: str | Compiled):
        made = compile_vocabulary(source) if isinstance(source, str) else source
        self.auto, self.special, self.label = Automaton(made.tables), made.special, made.label
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _ids(self, word: str) -> str:
        found = self.older.get(word) or ",".join(map(str, self.auto.encode(word.encode())))
        if len(word) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.older = self.words.copy()
                self.words.clear()
            self.words[word] = found
        return found

    def forget(self) -> None:
        """Drops the words and pairs met so far: a worker lives on through other operators' tasks."""
        for held in (self.words, self.older, self.auto.known, self.auto.older):
            held.clear()

    def _plain(self, text: str) -> list[str]:
        known, out = self.words, []
        for word in self.split.findall(text):
            out.append(known.get(word) or self._ids(word))
        return out

    def encode(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        parts, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            parts += self._plain(text[at : m.start()])
            parts.append(str(self.special[m[0]]))
            at = m.end()
        return ",".join(parts + self._plain(text[at:]))

    @property
    def by_decimal(self) -> dict[str, bytes]:
        held = self.__dict__.get("_by_decimal")
        if held is None:
            held = self._by_decimal = {str(i): b for i, b in self.label.items()}
        return held

    def decode(self, ids: str) -> bytes:
        """UTF-8 of the text of such ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.by_decimal.__getitem__, ids.split(","))) if ids else b""
        return raw.decode("utf-8", "replace").encode()


_ready: dict[int, Tokenizer] = {}


def _tokenizer(spec) -> Tokenizer:
    """A worker's tokenizer for a broadcast Compiled, made once."""
    if spec.bid not in _ready:
        _ready.clear()
        _ready[spec.bid] = Tokenizer(spec.value)
    return _ready[spec.bid]


class _Spec:
    """A broadcast with its number."""

    def __init__(self, spark, vocabulary: str):
        self.held, self.bid = spark.sparkContext.broadcast(compile_vocabulary(read_vocabulary(spark, vocabulary))), uuid.uuid4().int

    @property
    def value(self) -> Compiled:
        return self.held.value


def read_vocabulary(spark, path: str) -> str:
    """The vocabulary file's text: a path of this machine, or one with a scheme that Spark reads."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, n_tokens[, ids][, ids_sha256, decoded_sha256]) for each row of docs.

    vocabulary: path of a byte-level tokenizer's JSON file, read and compiled on the driver; its arrays are broadcast (a fixed size).
    ids: the ids as array<int>.  digests: SHA-256 of the decimal ids joined by commas, and of the text decoded from them.
    """
    spec = _Spec(docs.sparkSession, vocabulary)
    source = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("__text"))
    head = source.drop("__text").schema
    names = ["n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    kinds = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches):
        tok = _tokenizer(spec)
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in names}
            lists = []
            for raw in texts_of(batch.column(batch.num_columns - 1)):
                joined = tok.encode(raw.decode())
                columns["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                if ids:
                    lists.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
                if digests:
                    columns["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    columns["decoded_sha256"].append(hashlib.sha256(tok.decode(joined)).hexdigest())
            made = {n: pa.array(columns[n], kinds[n][1]) for n in names if n != "ids"}
            if ids:
                made["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(made[n] for n in names)], names=[*batch.schema.names[:-1], *names])
        tok.forget()

    for n in names:
        head = head.add(n, T.DataType.fromDDL(kinds[n][0]))
    return arrow_map(source, run, head)


def bpe_decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """rows with out_col, the text of the ids in ids_col (null stays null; a null or unknown id raises)."""
    spec = _Spec(rows.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def text(column):
        label = _tokenizer(spec).label
        return column.map(lambda ids: None if ids is None else b"".join(label[int(i)] for i in ids).decode("utf-8", "replace"))

    return rows.withColumn(out_col, text(F.col(ids_col)))
