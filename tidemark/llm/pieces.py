"""SentencePiece encoding by backtracking, and decoding (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .shared import arrow_map

SPACE = "▁"
#: Stands for a line end that follows its word without a space; no text that Arrow hands over holds it.
LINE = "\udfff"


class _Units(dict):
    """Ids by unit; what is not there is made."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> str:
        return self.make(word)


class PieceEncoder:
    """The ids of a merge-type (BPE) SentencePiece model with byte fallback and an identity normaliser.

    No piece has a space mark after another character, so the text falls into units, a space mark and what follows it up
    to the next, that are encoded apart and kept in a cache. Where no piece holds a line end, that ends a unit too and begins the next. A unit is encoded without running its merges: the automaton gives the longest
    piece at a place; a piece may follow another only if merging the two again gives the same two; where no piece may follow, the
    place is marked in a bitfield of failed positions and the encoder goes back one piece and tries its next shorter prefix.
    """

    def __init__(self, model: str, cache_units: int = 350_000, long_unit: int = 64):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.end = sp.eos_id()
        if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in self.id_of):
            raise ValueError("a piece of this model joins two units")
        reached = {p for p in self.id_of if self.merged([*p]) == [p]}
        #: The next shorter piece that begins each piece.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), None) for p in reached}
        self.auto = ahocorasick.Automaton()
        for p in reached:
            self.auto.add_word(p, len(p) - 1)
        self.auto.make_automaton()
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.id_of.items()} | {self.end: ""}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        alone = {i: chr(b) for b, i in self.byte_id.items() if b < 128}  # such a byte is a character whatever stands beside it
        self.text_for = {str(i): t for i, t in (self.text_of | alone).items()}
        self.digits = {p: str(i) for p, i in self.id_of.items()}
        self.lines_apart = not any("\n" in p for p in self.id_of)
        self.cache: dict[str, str] = _Units(self._make)
        self.older: dict[str, str] = {}
        self.cache_units, self.long_unit = cache_units, long_unit

    def merged(self, parts: list[str]) -> list[str]:
        """What the model's merges make of the parts: best score first, leftmost of equals."""
        parts, score = list(parts), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: str, b: str) -> bool:
        if self.n_fits > 1_000_000:
            self.fits.clear()
            self.n_fits = 0
        self.n_fits += 1
        known = a not in self.shorter or b not in self.shorter or self.merged([*a, *b]) == [a, b]
        self.fits.setdefault(a, {})[b] = known
        return known

    def unit(self, s: str) -> list[str]:
        """Pieces of one unit; a character that no piece covers is a piece of its own."""
        n, fits, shorter = len(s), self.fits, self.shorter
        longest = {end - less: end + 1 for end, less in self.auto.iter(s)}  # ends ascend, so the longest stays
        if len(longest) < n:
            longest = {i: i + 1 for i in range(n)} | longest
        failed = None
        end = longest[0]
        piece = s[:end]
        if end == n:
            return [piece]
        out, pos, last = [piece], end, piece
        follow = fits.get(piece) or {}
        end = longest[pos]
        piece = s[pos:end]
        while True:
            while piece is not None:
                end = pos + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    ok = follow.get(piece)
                    if ok is None:
                        ok = last is None or self._fit(last, piece)
                    if ok:
                        break
                piece = shorter.get(piece)
            if piece is not None:
                out.append(piece)
                if end == n:
                    return out
                pos, last = end, piece
                follow = fits.get(piece) or {}
                piece = s[pos : longest[pos]]
            else:
                failed = failed or bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(piece)
                piece = shorter.get(piece)
                last = out[-1] if out else None
                follow = fits.get(last) or {}

    def _run(self, n: int) -> list[str]:
        """Pieces of n space marks alone: all have one score, so the leftmost pair always merges first."""
        stack: list[str] = []
        for _ in range(n):
            stack.append(SPACE)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.score:
                b = stack.pop()
                stack[-1] += b
        return stack

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.id_of.get(p)
            if i is None:
                out += [self.byte_id[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def decode(self, ids: str) -> str:
        """Text of the decimal ids: pieces with spaces for marks, bytes as UTF-8, control ids left out, the first space dropped."""
        try:
            text = "".join(map(self.text_for.__getitem__, ids.split(" ")))
        except KeyError:
            text = self._plain([int(i) for i in ids.split()])
        return text[1:] if text[:1] == " " else text

    def _plain(self, ids: list[int]) -> str:
        try:
            return "".join([self.text_of[i] for i in ids])
        except KeyError:
            pass
        out, held = [], bytearray()
        for i in [*ids, self.end]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
            else:
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                out.append(self.text_of.get(i, ""))
        return "".join(out)

    def _make(self, word: str) -> str:
        """Ids of a space mark and the word, or of a line end and the word behind LINE, as text. They are decoded at once, and must give the word back."""
        if (out := self.cache.get(word) or self.older.get(word)) is None:
            line = word[:1] == LINE
            pieces = ["\n", *(self.unit(word[1:]) if len(word) > 1 else [])] if line else self.unit(SPACE + word)
            try:
                out = " ".join([self.digits[p] for p in pieces])
                back = "".join(pieces)
            except KeyError:
                ids = self._ids(pieces)
                out, back = " ".join(map(str, ids)), self._plain(ids)
            if back[1:] != word[line:]:
                raise ValueError(f"ids of {word!r} decode to {back!r}")
        if len(word) <= self.long_unit and word not in self.cache:
            if len(self.cache) >= self.cache_units:
                self.cache, self.older = _Units(self._make), self.cache
            self.cache[word] = out
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """The decimal ids with the end id, joined by spaces, and the text that decode() gives for all of them."""
        ids = self._encoded(text)
        return ids, self.decode(ids)

    def _encoded(self, text: str) -> str:
        if not text:
            return str(self.end)
        text = text.replace(SPACE, " ")
        words = (text.replace("\n", " " + LINE) if self.lines_apart else text).split(" ")
        ids_of = self.cache.__getitem__
        if "" not in words:
            return " ".join(map(ids_of, words)) + f" {self.end}"
        got, empty, mark = [], 0, self.digits[SPACE]
        for w in [*words, None]:
            if w == "":
                empty += 1
                continue
            unit = "" if w is None else ids_of(w)
            if empty:
                if unit == mark or unit.startswith(mark + " "):  # the unit's own mark stands alone and joins the run
                    empty, unit = empty + 1, unit[len(mark) + 1 :]
                got += [self.digits[p] for p in self._run(empty)]
                empty = 0
            if unit:
                got.append(unit)
        return " ".join(got) + f" {self.end}"


@lru_cache(1)
def encoder(model: str) -> PieceEncoder:
    """One encoder in each Python worker, kept from task to task with its cache."""
    return PieceEncoder(model)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row of docs: n_tokens, ids (decimal, space-joined, with the end id) and decoded, or with texts=False only their SHA-256.

    Null texts count as empty and give the end id alone; repeated rows give repeated results; an empty table gives none; other columns of
    docs are ignored. Row by row, so nothing is shuffled; a worker holds one batch, the model and a bounded cache.
    """
    names = f"{id_col} long, n_tokens long, " + ("ids string, decoded string" if texts else "ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            ids, dec, count = [], [], []
            for text in b.column(1):
                i, d = enc.encode(text.as_py() or "")
                count.append(i.count(" ") + 1)
                ids.append(i if texts else digest(i))
                dec.append(d if texts else digest(d))
            cols = [b.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in names.split(", ")])

    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")), run, names)
