"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels."""
from __future__ import annotations

import bisect
import functools
import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Fixed value: the pattern by which byte-level BPE splits a text before any merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 30
WORDS_KEPT = 150_000
CHUNK_CHARS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: themselves where printable, else 256, 257, ... in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _places(roots: list[int], made_of: dict[int, int], first: dict[int, int]) -> tuple[dict[int, int], Callable[[int, int], int]]:
    """A place for each token such that what was made of it, latest first, follows it; and the end of the run of a token
    and of what was made of it by rule r or a later one."""
    size = dict.fromkeys((*roots, *made_of), 1)
    made: dict[int, list[int]] = {}
    for token in reversed(made_of):  # latest rule first
        size[made_of[token]] += size[token]
        made.setdefault(made_of[token], []).append(token)
    place: dict[int, int] = {}
    todo = roots[::-1]
    while todo:
        token = todo.pop()
        place[token] = len(place)
        todo += reversed(made.get(token, ()))

    def end(token: int, r: int) -> int:
        """Latest comes first, so the run ends where the first one made before rule r stands."""
        of = made.get(token, ())
        k = bisect.bisect_right(of, -r, key=lambda t: -first[t])
        return place[of[k]] if k < len(of) else place[token] + size[token]

    return place, end


def _strike(table: np.ndarray, top: int, bottom: int, left: int, right: int) -> None:
    """Set the bits left..right-1 of the rows top..bottom-1."""
    lo, hi = left >> 3, right >> 3
    start, stop = 0xFF << (left & 7) & 0xFF, (1 << (right & 7)) - 1
    if lo == hi:
        table[top:bottom, lo] |= start & stop
        return
    table[top:bottom, lo] |= start
    table[top:bottom, lo + 1:hi] = 0xFF
    if stop:
        table[top:bottom, hi] |= stop


class Automaton(dict):
    """The deterministic automaton over tokens that successive merge gadgets leave; as a mapping it gives the ids of a word.

    States are tokens: after a token's arc one stands in that token's state. The start has a state per byte with arcs on
    all bytes. Rule number r, (x, y) -> z, adds a gadget: the state of x loses the arc y, and every state with an arc x
    gets an arc z into a copy of the state that y led to at that moment; where x has lost y before, the gadget is void. Merges
    that join a token which only a later merge makes (no training gives such) are refused.

    A copy shares its row with the state it was copied from until either loses an arc, and an arc z shares its column with
    x. States in the order of copies (`_places`) hence make the states that lose an arc by one rule a run of rows, and the
    arcs they lose a run of columns: rule by rule a rectangle of the table is struck out. Rows and columns that no
    rectangle parts are one. Bit c of `rows[state]` is set where the state has no arc on the tokens of column c;
    `columns[token]` is (byte, mask). 50,000 merges make a table of 23 MB before equal rows are shared.

    Each word has one path from the start, and its labels are the word's encoding. A word longer than the longest token
    costs time in proportion to its length.
    """

    def __init__(self, labels: list[bytes], rules: list[tuple[int, int, int]]):
        super().__init__()
        self.labels: list[bytes] = labels
        self.before: dict[str, bytes] = {}
        first: dict[int, int] = {}
        gadgets: dict[tuple[int, int], int] = {}
        singles = [i for i, label in enumerate(labels) if len(label) == 1]

        def edge(token: int, side: int) -> list[tuple[int, int]]:
            """The tokens along one edge of a token's gadgets, each with the rule at which it was used up."""
            out = [(token, len(rules))]
            while (r := first.get(out[-1][0])) is not None:
                out.append((rules[r][side], r))
            return out

        alive, early = set(singles), []
        for r, (x, y, z) in enumerate(rules):
            if x not in alive or y not in alive:
                early.append((x, y))
                continue
            left = edge(y, 0)
            if any(gadgets.get((a, b), NEVER) < until_a and gadgets[a, b] <= until_b for a, until_a in edge(x, 1) for b, until_b in left):
                continue
            gadgets[x, y] = r
            if z not in alive:
                alive.add(z)
                first[z] = r
        if any(x in alive and y in alive for x, y in early):
            raise ValueError("a merge joins a token that only a later merge makes")
        runs, places = [], []
        for side, late in ((1, 1), (0, 0)):  # copies of a state made by later rules; arcs built on an arc by this rule or later ones
            place, ends = _places(singles, {z: rules[r][side] for z, r in first.items()}, first)
            runs.append([(place[pair[1 - side]], ends(pair[1 - side], r + late)) for pair, r in gadgets.items()])
            places.append(place)
        self.rows: dict[int, bytes] = {}
        self.columns: dict[int, tuple[int, int]] = {}
        edges = [np.unique(np.array(run, np.int64).reshape(-1)) for run in runs]
        row_of, column_of = (dict(zip(place, np.searchsorted(edge, list(place.values()), side="right").tolist())) for place, edge in zip(places, edges))
        spans = [np.searchsorted(edge, np.array(run, np.int64).reshape(-1, 2)) + 1 for run, edge in zip(runs, edges)]
        table = np.zeros((len(edges[0]) + 1, len(edges[1]) // 8 + 1), np.uint8)
        for (top, bottom), (left, right) in zip(*(span.tolist() for span in spans)):
            _strike(table, top, bottom, left, right)
        shared: dict[bytes, bytes] = {}
        kept = [shared.setdefault(row, row) for row in map(np.ndarray.tobytes, table)]
        for token in (*singles, *first):
            self.rows[token] = kept[row_of[token]]
            self.columns[token] = (column_of[token] >> 3, 1 << (column_of[token] & 7))
        self.ids: dict[bytes, int] = {labels[i]: i for i in (*singles, *first)}
        self.longest = max(map(len, self.ids), default=0)

    def walk(self, word: bytes) -> list[int]:
        """The word's path. For each place, the one token whose arc can end there; then back along the labels."""
        last: list[int] = [-1]
        held: list[bytes] = [b""]
        ids, longest, rows, columns = self.ids.get, self.longest, self.rows, self.columns
        for end in range(1, len(word) + 1):
            start = 0
            if end <= longest:
                token, start = ids(word[:end]), 1  # the start has an arc on every token
                if token is not None:
                    last.append(token)
                    held.append(rows[token])
                    continue
            else:
                start = end - longest
            for start in range(end - 1, start - 1, -1):
                token = ids(word[start:end])
                if token is not None:
                    byte, mask = columns[token]
                    if not held[start][byte] & mask:
                        last.append(token)
                        held.append(rows[token])
                        break
        out, end, labels = [], len(word), self.labels
        while end:
            token = last[end]
            out.append(token)
            end -= len(labels[token])
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        """Ids of a pre-split word as little-endian 32-bit integers; two tables of bounded size keep those seen."""
        got = self.before.get(piece)
        if got is None:
            path = self.walk(piece.encode())
            got = struct.pack(f"<{len(path)}I", *path)
        if len(self) >= WORDS_KEPT:
            self.before = dict(self)
            self.clear()
        self[piece] = got
        return got


class Tokenizer:
    """A byte-level BPE file (JSON with vocab, merges and added tokens): its automaton, split and added tokens."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, alphabet = data["model"], byte_alphabet()
        if model["type"] != "BPE" or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data.get("normalizer"):
            raise ValueError("a byte-level BPE without a normalizer is needed")
        if data["pre_tokenizer"].get("add_prefix_space") or not data["pre_tokenizer"].get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("prefix spaces, other splits and ignored merges are not supported")
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data.get("added_tokens") or []):
            raise ValueError("added tokens that take spaces or whole words are not supported")
        vocab = model["vocab"]
        labels = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            labels[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.added.items():
            labels[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(labels, [(vocab[x], vocab[y], vocab[x + y]) for x, y in merges])
        self._split = regex.compile(SPLIT).findall
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.automaton.__getitem__, self._split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [self._plain(text[at:m.start()]), struct.pack("<I", self.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs in turn; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.automaton.labels.__getitem__, memoryview(ids).cast("I")))
        return data.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def _tokenizer(spec: str) -> Tokenizer:
    """One automaton and word table per Python worker, shared by its tasks."""
    return Tokenizer(spec)


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256, decoded_sha256 and, `with_ids`, ids (array<int>) and decoded (string).

    Whole texts; null and empty texts have no token and the digests of nothing. The tokenizer file is read where the
    plan is built and travels with the tasks; its size is fixed. Columns other than those named are not looked at.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    source = docs.select(*keep, docs[text].alias("_t")) if "_t" not in keep else docs.select(*keep, text)
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    added = StructType.fromDDL(extra)
    if {c.lower() for c in keep} & {c.lower() for c in added.names}:
        raise ValueError("rename kept columns that have an output's name")
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in keep), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
                for value in part.column(part.num_columns - 1):
                    ids = tokenizer.encode(value.as_py() or "")
                    back = tokenizer.decode(ids)
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        ids_out.append(pa.array(memoryview(ids).cast("I"), pa.int32()))
                        text_out.append(back.decode())
                arrays = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    arrays += [pa.array([x.to_pylist() for x in ids_out], pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)
