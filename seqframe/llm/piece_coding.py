"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

Merging pairs step by step and searching for the result are two ways to the same tokens: a sequence of pieces is what the merges
make of a text if each piece comes out of its own characters, and each two neighbours come out as these two when their joint
text is merged anew.  So the encoder reads the text once from left to right:

1. An Aho-Corasick automaton over all pieces gives, in one pass, the longest piece that starts at each position.
2. That piece is tried, then ever shorter ones that begin it, until one agrees with the piece before: their joint text is merged
   again and has to fall into the same two pieces.  Answers are kept.
3. If none agrees the piece before is given up, its start is marked in a bitfield of failed positions, which no later trial may
   end at, and the search goes on with a shorter piece there.  Each position fails once at most, so time is linear.

Texts are cut first where no piece of the model can lie across: before spaces, at characters that no piece holds, and, if the
model's pieces keep letters and other characters apart, between these.  Cuts are checked against the model's own pieces when it
is loaded.  Parts of up to CACHED characters are encoded once and kept in a table of bounded size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: piece types, the model type of merges, and the sign that stands for a space.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES, SPACE = 2, "▁"
#: Characters of parts that are kept; parts kept, in each of two generations; neighbours' answers kept; characters cut up at a time.
CACHED, PARTS, PAIRS, SLICE = 64, 1 << 19, 1 << 20, 1 << 18


def _fields(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (body[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if body[at - 1] < 128:
                return value

    while at < len(body):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = varint() if size is None else size
            yield key >> 3, body[at : at + size]
            at += size


class _Parts(dict):
    """Token ids of parts, as bytes; the parts used since the last change of generations, and in `old` those before."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(part)
        if len(part) <= CACHED:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class PieceModel:
    """A model of type BPE without a character map; other models raise ValueError."""

    def __init__(self, body: bytes, parts: int = PARTS):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in _fields(body):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kinds = {k for _, _, k in self.pieces}
        if trainer.get(3, 1) != MERGES or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model is of merges and has no user-defined or unused pieces")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24):
            raise ValueError("the model's rules are: no character map, spaces kept and escaped, no suffix form")
        self.prefixed = bool(rules.get(3, 1))
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.scores = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.controls = {i for i, p in enumerate(self.pieces) if p[2] == CONTROL}
        control = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == CONTROL}
        #: The names that begin and end bear unless the model says otherwise.
        self.bos, self.eos = (control.get((trainer.get(n) or name.encode()).decode(), -1) for n, name in ((46, "<s>"), (47, "</s>")))
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("each character of a piece is a piece")
        self.characters = {p for p in self.ids if len(p) == 1}
        self.shorter, self.size = [-1] * len(self.pieces), [0] * len(self.pieces)
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
            self.size[i] = len(p)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.agree: dict[int, bool] = {}
        self.cut = self._cuts()
        self.parts = _Parts(self._encode_part, parts)
        self.spelled = self._spelled()

    def _cuts(self) -> re.Pattern | None:
        """A pattern whose matches cut a text up where no piece can lie across; None if pieces hold spaces behind other characters."""
        bodies = [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in b for b in bodies):
            return None
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c != " " and c not in self.ids)
        single = f"[{alone}]|" if alone else ""
        letter = re.compile(r"[^\W\d_]")
        if all(len({bool(letter.match(c)) for c in b}) < 2 for b in bodies):
            return re.compile(rf"{single}{SPACE}*[^\W\d_]+|{SPACE}*(?:[^\w{SPACE}{alone}]|[\d_])+|{SPACE}+")
        return re.compile(rf"{single}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text of known characters: the best-scored neighbours first, of equal ones the leftmost."""
        parts, score = list(text), self.scores.get
        joint = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]  # of each two neighbours
        while True:
            best = max([s for s in joint if s is not None], default=None)
            if best is None:
                return parts
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            for i in (at - 1, at):
                if 0 <= i < len(joint):
                    joint[i] = score(parts[i] + parts[i + 1])

    def agrees(self, before: int, piece: int) -> bool:
        """Whether merges leave the two side by side; before = -1: whether they make the piece of its characters."""
        known = self.agree.get(before << 32 | piece)
        if known is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            parts = [self.pieces[i][0] for i in (before, piece) if i >= 0]
            known = self.agree[before << 32 | piece] = self.merged("".join(parts)) == parts
        return known

    def search(self, text: str) -> list[int]:
        """Pieces of a text of known characters, by backtracking."""
        n, known, shorter, size = len(text), self.agree.get, self.shorter, self.size
        longest = [0] * n if n <= CACHED else np.zeros(n, dtype=np.int32)
        # matches come by their end, so of those that start at one position the longest comes last
        for end, (length, piece) in self.automaton.iter(text):
            longest[end - length + 1] = piece
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, before, piece = 0, -1, int(longest[0])
        while True:
            while piece >= 0:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = known(before << 32 | piece)
                    if self.agrees(before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = end
                if at == n:
                    return out
                before, piece = piece, int(longest[at])
            elif before < 0:
                raise AssertionError("a text of known characters has an encoding")
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= size[piece]
                before = out[-1] if out else -1

    def _encode_part(self, part: str) -> bytes:
        if self.characters.issuperset(part):
            ids = self.search(part)
            return struct.pack(f"<{len(ids)}I", *ids)
        out, at = [], 0
        while at < len(part):
            to = at
            while to < len(part) and part[to] in self.characters:
                to += 1
            ids = self.search(part[at:to]) if to > at else []
            for c in part[to : to + 1]:
                ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
            at = to + 1
        return b"".join(out)

    def encode_bytes(self, text: str, bos: bool = False, eos: bool = False) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out = [struct.pack("<I", self.bos)] if bos else []
        if text:
            text = text.replace(" ", SPACE)
            if self.prefixed:
                text = SPACE + text
            if self.cut is None:
                out.append(self._encode_part(text))
            elif len(text) <= SLICE:
                out += map(self.parts.__getitem__, self.cut.findall(text))
            else:  # a part at a time, so that a long text's parts are not all held
                out += (b"".join(map(self.parts.__getitem__, self.cut.findall(piece))) for piece in _slices(text))
        if eos:
            out.append(struct.pack("<I", self.eos))
        return b"".join(out)

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        return np.frombuffer(self.encode_bytes(text, bos, eos), dtype="<u4").tolist()

    def _spelled(self) -> list[bytes]:
        """What each id stands for."""
        #: Fixed value: what an unknown piece is shown as.
        unknown = " ⁇ "
        show = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), UNKNOWN: lambda p: unknown.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        return [show[k](p) for p, _, k in self.pieces]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; bytes that are not UTF-8 become U+FFFD one by one.  An id outside the vocabulary raises IndexError."""
        spelled, runs, at = self.spelled, [], 0
        ids = ids[next((i for i, t in enumerate(ids) if t not in self.controls), len(ids)) :]
        while ids and ids[-1] in self.controls:
            ids.pop()
        for i in [] if self.controls.isdisjoint(ids) else [i for i, t in enumerate(ids) if t in self.controls]:  # they end a run of bytes
            runs.append(b"".join([spelled[t] for t in ids[at:i]]))
            at = i + 1
        runs.append(b"".join([spelled[t] for t in ids[at:]]))
        if self.prefixed and ids and self.pieces[ids[0]][2] == NORMAL and self.pieces[ids[0]][0].startswith(SPACE):
            runs[0] = runs[0][1:]
        return "".join([r.decode(errors="surrogateescape") for r in runs]).translate(_BROKEN)


#: Stray bytes, as Python shows them.
_BROKEN = dict.fromkeys(range(0xDC80, 0xDD00), "\ufffd")


def _slices(text: str) -> Iterator[str]:
    """The text in slices of about SLICE characters that end before a space behind another character."""
    border, at = re.compile(f"(?<=[^{SPACE}]){SPACE}"), 0
    while at < len(text):
        found = border.search(text, min(len(text), at + SLICE))
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


_loaded: dict[bytes, PieceModel] = {}


def _model(body: bytes) -> PieceModel:
    """A worker builds the automaton once and keeps its parts from task to task; one model at a time."""
    if body not in _loaded:
        _loaded.clear()
        _loaded[body] = PieceModel(body)
    return _loaded[body]


def _code(batches, body: bytes, bos: bool, eos: bool):
    model = _model(body)
    for block in tc.blocks(batches, "text"):
        coded = [model.encode_bytes(t or "", bos, eos) for t in block.column("text").to_pylist()]
        decoded = [model.decode(np.frombuffer(c, dtype="<u4").tolist()) for c in coded]
        yield pa.record_batch([block.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


def code_pieces(docs: DataFrame, model_path: str = DEFAULT_MODEL, bos: bool = True, eos: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded (the text of the ids).

    Null counts as the empty text, which has the begin and end ids alone and decodes to the empty text.  Every text is encoded
    whole, whatever its length; repeated rows and rows without an id stand for themselves; an empty table gives no rows; other
    columns are not read.  The driver reads the model from model_path and sends it to the tasks (about 0.5 MB).
    """
    with open(model_path, "rb") as f:
        body = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary, decoded string"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: _code(it, body.value, bos, eos), schema)


def digest_pieces(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of code_pieces' rows."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
