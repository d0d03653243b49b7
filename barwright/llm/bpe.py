"""BPE encoding and decoding of whole texts with a published vocabulary.

The encoder is a streaming transducer over the symbols of a word. After each symbol it knows the last token of
the encoding of what it has read: the one token that ends here and stands beside the last token of the rest as
the merge list would leave the two. A token that reaches past the present symbol starts within the last
``lookahead`` symbols (the longest token of the merge list). So all encodings that can still come about pass
through one of these places, and what the paths back from them have in common is final and is given out. No more
than the undecided part of a word is held.

Words recur, so their tokens are remembered between blanks; the store has a fixed size and only saves time.

The decoder takes one id after the other and holds the undecided bytes of at most one character.

Defined cases
- A null text is encoded like an empty one: no ids.
- The strings of special tokens are special tokens in a text, as the library has it by default.
- Rows keep their ``doc_id``, null or repeated; other columns take no part.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barwright.llm.common import column

# --- fixed values: white space and word pattern of the published tokenizer ---
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORD = "|".join(CONTRACTIONS) + rf"|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"
# -----------------------------------------------------------------------------
#: Python's split() also cuts at these four, which are no white space for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters up to here have had their case, form and class in every version of Unicode, so Python and the library agree on them. Units
#: with any other one take the library's own normalizer and splitter.
SETTLED = "\u024f"
REMEMBERED = 600_000
OUT_ROWS = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a tokenizer file, with the questions the transducer asks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.parts = [tuple(m) for m in merges]
        # the merge that makes each token, if no token has two
        made = {a + b: i for i, (a, b) in enumerate(merges)}
        self.made = made if len(made) == len(merges) else None
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.named = spec.get("decoder") is None
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.symbols = dict(enumerate(byte_symbols()))
        self.lookahead = max(len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.ids)
        self.together: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}

    def cut(self, token: str) -> list[str]:
        """The symbols a token is made of; the last one carries the end-of-word mark."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The merge list applied to a few symbols."""
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts = parts[:at] + [parts[at] + parts[at + 1]] + parts[at + 2 :]
        return parts

    def stands(self, token: str) -> bool:
        """The merge list makes this token of its own symbols."""
        known = self.single.get(token)
        if known is None:
            known = self.single[token] = len(self.merged(self.cut(token))) == 1
        return known

    def beside(self, left: str, right: str) -> bool:
        """The merge list leaves these two tokens as they are when they stand side by side."""
        known = self.together.get((left, right))
        if known is None:
            if len(self.together) > REMEMBERED:
                self.together.clear()
            if self.made is None:
                known = self.merged(self.cut(left) + self.cut(right)) == [left, right]
            else:
                known = self._stay_apart(left, right)
            self.together[left, right] = known
        return known

    def _stay_apart(self, left: str, right: str) -> bool:
        """``beside`` without merging: takes the two tokens apart along their seam, latest merge first.

        Before the merges of rank ``before`` the parts at the seam stood side by side; had they been a merge of a smaller rank, they
        would have been joined. Merges of one rank run from the left, so a merge inside the left token comes first.
        """
        rank, made, never = self.rank, self.made, 1 << 60
        before = never
        while True:
            if rank.get((left, right), never) < before:
                return False
            at_left, at_right = made.get(left, -1), made.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                before, left = at_left, self.parts[at_left][1]
            else:
                before, right = at_right + 1, self.parts[at_right][0]


class Transducer:
    """Symbols of one word in, tokens out as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.text = ""  # undecided symbols
        self.last: list[str] = [""]  # last token of each prefix of the undecided part
        self.context = ""  # the last token given out

    def _step(self, end: int, mark: str) -> None:
        ids, merges, text, last = self.merges.ids, self.merges, self.text, self.last
        for start in range(max(0, end - merges.lookahead), end):
            token = text[start:end] + mark
            if token in ids:
                before = last[start] if start else self.context
                if merges.beside(before, token) if before else merges.stands(token):
                    last.append(token)
                    return
        raise ValueError(f"no token ends at {text[max(0, end - 8):end]!r}")

    def _settle(self) -> list[str]:
        """Tokens that all paths from the last ``lookahead`` places have in common."""
        def back(at: int) -> int:
            return at - len(self.last[at])

        places = set(range(max(0, len(self.text) - self.merges.lookahead + 1), len(self.text) + 1))
        while len(places) > 1:
            far = max(places)
            places.remove(far)
            places.add(back(far))
        done = places.pop()
        out, at = [], done
        while at:
            out.append(self.last[at])
            at = back(at)
        if done:
            self.context = self.last[done]
            self.text, self.last = self.text[done:], ["", *self.last[done + 1 :]]
        return out[::-1]

    def feed(self, symbols: str) -> list[str]:
        """More symbols of a word that goes on after them."""
        out: list[str] = []
        for symbol in symbols:
            self.text += symbol
            self._step(len(self.text), "")
            if len(self.text) >= 2 * self.merges.lookahead:
                out += self._settle()
        return out

    def word(self, symbols: str) -> list[str]:
        """A whole word. A short one is stepped through at once: it would end before anything is given out."""
        merges, size = self.merges, len(symbols)
        if size > 2 * merges.lookahead:
            return self.feed(symbols[:-1]) + self.finish(symbols[-1])
        ids, known, reach = merges.ids, merges.together, merges.lookahead
        last = [""] * (size + 1)
        for end in range(1, size + 1):
            mark = merges.suffix if end == size else ""
            for start in range(max(0, end - reach), end):
                token = symbols[start:end] + mark
                if token in ids:
                    before = last[start]
                    fits = known.get((before, token))
                    if fits is None:
                        fits = merges.beside(before, token) if before else merges.stands(token)
                        known[before, token] = fits
                    if fits:
                        last[end] = token
                        break
        out, at = [], size
        while at:
            token = last[at]
            out.append(token)
            at -= len(token) - (len(merges.suffix) if at == size else 0)
        return out[::-1]

    def finish(self, symbol: str) -> list[str]:
        """The word's last symbol; all that is left comes out."""
        self.text += symbol
        self._step(len(self.text), self.merges.suffix)
        out, at = [], len(self.text)
        suffix = len(self.merges.suffix)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(token) - (suffix if at == len(self.text) else 0)
        self.text, self.last, self.context = "", [""], ""
        return out[::-1]


class Encoder:
    """Texts to ids: normal form, special tokens, words, then the transducer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.unsettled = re.compile(f"[^\x00-{SETTLED}]")
        self.word = regex.compile(WORD)
        self.blank = regex.compile(f"[{BLANK}]+")
        marks = "|".join(regex.escape(s) for s in self.merges.special)
        self.special = regex.compile(f"({marks})") if marks else None
        self.transducer = Transducer(self.merges)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def word_ids(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            found = self.transduce(word)
            if len(self.words) > REMEMBERED:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = found
        return found

    def transduce(self, word: str) -> list[int]:
        symbols = word.encode("utf-8").decode("latin-1").translate(self.merges.symbols)
        return [self.merges.ids[t] for t in self.transducer.word(symbols)]

    def unit(self, unit: str, settled: bool = True) -> bytes:
        """Ids, as little-endian integers, of what stands between two blanks; in lower case if it is settled."""
        found = self.known.get(unit)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if settled:
                ids = [i for word in self.word.findall(unit) for i in self.word_ids(word)]
            else:
                pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(unit))
                ids = [self.merges.ids[t] for piece, _ in pieces for t in self.transducer.word(piece)]
            found = np.array(ids, "<i4").tobytes()
            if len(unit) < 64:
                self.known[unit] = found
        return found

    def units(self, text: str) -> list[str]:
        return self.blank.split(text) if any(s in text for s in SEPARATORS) else text.split()

    def plain(self, text: str) -> Iterator[bytes]:
        known = self.known
        if self.unsettled.search(text) is None:
            for unit in self.units(text.lower()):
                yield known.get(unit) or self.unit(unit)
            return
        for unit in self.units(text):
            if self.unsettled.search(unit) is None:
                unit = unit.lower()
                yield known.get(unit) or self.unit(unit)
            else:
                yield known.get(unit) or self.unit(unit, settled=False)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = text or ""
        if self.special is None or not any(s in text for s in self.merges.special):
            return b"".join(self.plain(text))
        out = []
        for i, part in enumerate(self.special.split(text)):
            out.append(np.array([self.merges.special[part]], "<i4").tobytes() if i % 2 else b"".join(self.plain(part)))
        return b"".join(out)


class Decoder:
    """Ids to text, one after the other.

    ``plain``: tokens under the names of the vocabulary file with a blank between them, as a tokenizer file
    without a decoder has it; left out, the file decides. Otherwise the bytes they stand for, the end-of-word mark as a blank; bytes wait
    until their character is complete.
    """

    def __init__(self, merges: Merges, plain: bool | None = None):
        self.merges, self.names, self.begun = merges, merges.names, False
        self.by_name = merges.named if plain is None else plain
        self.byte = {s: b for b, s in merges.symbols.items()}
        self.characters = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        name = self.names[token]
        if self.by_name:
            out = f" {name}" if self.begun else name
            self.begun = True
            return out
        suffix = self.merges.suffix
        ends = bool(suffix) and name.endswith(suffix)
        body = name[: -len(suffix)] if ends else name
        if name in self.merges.special:
            return self.characters.decode(b"", True) + name
        return self.characters.decode(bytes(self.byte[c] for c in body)) + (" " if ends else "")

    def finish(self) -> str:
        self.begun = False
        return "" if self.by_name else self.characters.decode(b"", True)

    def decode(self, ids: list[int]) -> str:
        """A whole list at once; equals feeding one after the other."""
        if self.by_name and not self.begun:
            return " ".join(map(self.names.__getitem__, ids))
        return "".join(map(self.feed, ids)) + self.finish()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def list_array(parts: list[bytes]) -> pa.Array:
    """Byte strings of 32-bit integers as a list column."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        dec = Decoder(enc.merges)
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                texts = [dec.decode(np.frombuffer(i, "<i4").tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_array(ids), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )

    return run


def encode_and_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for every row; ``path`` must be readable on every executor."""
    docs = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    return docs.mapInArrow(coder(path), "doc_id long, ids array<int>, decoded string")
