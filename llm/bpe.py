"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

Encoding reads a word symbol by symbol. For every prefix it keeps the last token of that prefix' own encoding: the one
token that ends there, is what the merges make of its own symbols, and stays apart from the last token of the prefix
before it when both are merged together. A sequence of tokens is the encoding of its text exactly if all neighbours stay
apart, so there is one such token and nothing that follows changes it for the prefix. No future token reaches back further
than the longest product of the merge list, `lookahead` symbols; a boundary on which the chains of all prefixes within
that window agree is stable, and the tokens before it are emitted and forgotten. Memory is that of the window, also for a
word of any length.

Decoding feeds token ids to a state machine that holds back the bytes of an incomplete character and gives text as soon as
it is complete.

The vocabulary file is one of a public tokenizer, in the JSON form of the tokenizers library; its path is a parameter. The
driver reads it once and broadcasts it: its size is fixed and known.

Defined results: a null text is encoded as the empty text, with no ids; long texts are encoded whole; every input row gives
a row, repeated ones too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm.shared import plain, text_or_empty

#: What a worker remembers at once of pieces, words and beginnings of words, and of neighbours; twice that with the ones before,
#: and at most twice that of neighbours.
REMEMBERED, NEIGHBOURS = 150_000, 400_000
#: Length of the beginnings of words that are remembered.
HEAD = 6
#: Longest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20


def visible_bytes() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Memory(dict):
    """What was asked for of late: when full, it becomes the past and begins anew; what is found in the past comes back."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.past = most, {}

    def find(self, key):
        value = self.get(key)
        if value is None and (value := self.past.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.past = dict(self)
            self.clear()
        self[key] = value


class Place:
    """Where a word's reading stands: the longest end of what was read that begins a token, the tokens that end there (longest
    first, as number and symbols), and where each further symbol leads. There are no more places than beginnings of tokens."""

    __slots__ = ("text", "tokens", "next", "closing")

    def __init__(self, text: str, tokens: list):
        self.text, self.tokens, self.next, self.closing = text, tokens, {}, {}


class Merges:
    """A merge list, its tokens and what is known about neighbours so far."""

    def __init__(self, merges: list, tokens: Iterable[str], end: str):
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(merges)}
        #: Of a token, the rank of its merge and the two parts.
        self.made = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        self.names, self.end = list(tokens), end
        self.tokens = {t: i for i, t in enumerate(self.names)}
        bodies = [t.removesuffix(end) if end else t for t in self.names]
        #: Symbols of each token, and of the longest product: no token reaches back further.
        self.length = list(map(len, bodies))
        self.lookahead = max(self.length, default=1)
        self.begun = {t[:n] for t in bodies for n in range(len(t) + 1)}
        self.places: dict[str, Place] = {}
        #: Of a token, what is known of the tokens before it; and how many such pairs are known in all.
        self.apart: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.root = self.place("")
        self.heads = Memory()

    def symbols(self, token: str, last: bool) -> list[str]:
        if not (last and self.end):
            return list(token)
        body = token.removesuffix(self.end)
        return [*body[:-1], body[-1] + self.end]

    def merged(self, parts: list[str]) -> list[str]:
        """The merge list applied to a few symbols, lowest rank first, leftmost first."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def ending(self, text: str, last: bool) -> list[tuple[int, int, dict[int, bool]]]:
        """The tokens at the end of a text that are what their own symbols merge to, longest first, as number, symbols and what
        is known of the tokens before."""
        end = self.end if last else ""
        found = ((text[at:] + end, len(text) - at) for at in range(len(text)))
        tokens = [(self.tokens[t], k) for t, k in found if t in self.tokens and self.merged(self.symbols(t, last)) == [t]]
        return [(t, k, self.apart.setdefault(t, {})) for t, k in tokens]

    def meet(self, left: int, token: int, known: dict[int, bool]) -> bool:
        """Whether two neighbours stay apart, from now on known; when too many are, all are forgotten."""
        if self.pairs >= 2 * NEIGHBOURS:
            self.pairs = 0
            for pairs in self.apart.values():
                pairs.clear()
        self.pairs += 1
        fit = known[left] = self.stay_apart(self.names[left], self.names[token])
        return fit

    def place(self, text: str) -> Place:
        found = self.places.get(text)
        if found is None:
            found = self.places[text] = Place(text, self.ending(text, False))
        return found

    def onward(self, place: Place, symbol: str) -> Place:
        """The place after a symbol, kept where it is met first."""
        text = place.text + symbol
        while text not in self.begun:
            text = text[1:]
        found = place.next[symbol] = self.place(text)
        return found

    def closing(self, place: Place, symbol: str) -> list[tuple[int, int, dict[int, bool]]]:
        """The tokens that end a word with a last symbol."""
        found = place.closing[symbol] = self.ending(place.text + symbol, True)
        return found

    def stay_apart(self, left: str, right: str) -> bool:
        """Both, merged together, stay as they are. The merges that made them are undone along the seam, latest first;
        what then meets at the seam must not merge before the merge just undone. Of equal merges the left one is first."""
        made, rank = self.made, self.rank
        before = 1 << 60
        while True:
            across = rank.get((left, right))
            if across is not None and across < before:
                return False
            one, two = made.get(left), made.get(right)
            if one is not None and (two is None or one[0] > two[0]):
                before, left = one[0], one[2]
            elif two is not None:
                before, right = two[0] + 1, two[1]
            else:
                return True

    def transduce(self, symbols: str) -> Iterator[str]:
        """The tokens of one word, each as soon as it is stable."""
        return map(self.names.__getitem__, self.numbers(symbols))

    def numbers(self, symbols: str) -> Iterable[int]:
        """The same as places in the list of tokens."""
        if len(symbols) > 4 * self.lookahead:
            return self.windows(symbols)
        ends: list = []
        self.read(symbols, ends, -1, True)
        return self.chain(ends, len(ends))

    def windows(self, symbols: str) -> Iterator[int]:
        """The same of a long word."""
        window, ends, before = "", [], -1  # symbols not emitted, the token that ends at each, the token before them or none
        at, step = 0, 4 * self.lookahead
        while at < len(symbols):
            part = symbols[at : at + step]
            at += len(part)
            window += part
            self.read(window, ends, before, at == len(symbols))
            cut = len(ends) if at == len(symbols) else self.stable(ends)
            if cut:
                out = self.chain(ends, cut)
                yield from out
                window, ends, before = window[cut:], ends[cut:], out[-1]

    def read(self, window: str, ends: list, before: int, whole: bool) -> None:
        """Add the last token of each prefix of the window that ends has none of yet."""
        place, at, total, meet = self.root, 0, len(window), self.meet
        first = before < 0 and not ends and total > HEAD
        if first:  # what ends at the symbols of a word's beginning is the same in all words that begin so
            if found := self.heads.find(window[:HEAD]):
                place, at = found[0], HEAD
                ends += found[1]
                first = False
        known, closed = len(ends), total - 1 if whole and self.end else total
        for n in range(at, total):
            if n == HEAD and first:
                self.heads.keep(window[:HEAD], (place, ends[:]))
            symbol = window[n]
            if n < closed:
                place = place.next.get(symbol) or self.onward(place, symbol)
                if n < known:
                    continue
                tokens = place.tokens
            elif (tokens := place.closing.get(symbol)) is None:
                tokens = self.closing(place, symbol)
            for token, k, apart in tokens:
                left = ends[n - k] if k <= n else before
                if left >= 0:
                    fit = apart.get(left)
                    if not (meet(left, token, apart) if fit is None else fit):
                        continue
                ends.append(token)
                break
            else:
                raise ValueError(f"no token for the last symbol of {window[: n + 1]!r}")

    def stable(self, ends: list) -> int:
        """The last boundary that the chains of all prefixes within the lookahead share."""
        shared = None
        for at in range(len(ends) - self.lookahead, len(ends) + 1):
            marks = set()
            while at > 0:
                marks.add(at)
                at -= self.length[ends[at - 1]]
            shared = marks if shared is None else shared & marks
        return max(shared, default=0)

    def chain(self, ends: list, at: int) -> list[int]:
        out = []
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]


class Tokenizer:
    """Encoding and decoding with a vocabulary file whose words end in a suffix, lower case, split at classes."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.names = {i: t for t, i in self.ids.items()}
        self.end = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["merges"], model["vocab"], self.end)
        self.number = [self.ids[t] for t in self.merges.names]
        self.digits = list(map(str, self.number))
        self.labels = [self.names[i] for i in self.number]
        self.bytes = visible_bytes()
        self.byte_of, self.complete = {c: b for b, c in enumerate(self.bytes)}, {}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.opening = {t[0] for t in self.special}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known, self.by_word = Memory(), Memory()

    def read_word(self, word: str) -> tuple[str, str, str]:
        """Of one word of the pre-tokenizer: its ids and their names, joined by spaces, and what the state machine decodes them
        to. The last token ends the word and leads the state machine back to its beginning."""
        made = self.by_word.find(word)
        if made is None:
            symbols = word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode()])
            numbers = list(self.merges.numbers(symbols))
            texts = list(map(self.complete.get, ids := [self.number[t] for t in numbers]))
            text = "".join(texts) if None not in texts else self.decode(ids)
            made = " ".join([self.digits[t] for t in numbers]), " ".join([self.labels[t] for t in numbers]), text
            if len(word) <= 100:
                self.by_word.keep(word, made)
        return made

    def read_chunk(self, chunk: str) -> tuple[str, str, str]:
        """Of a piece of text without white space: its ids, and what the library and the state machine decode them to."""
        if chunk.isascii():
            if chunk.isalpha():
                return self.read_word(chunk.lower())
            if not any(c in chunk for c in self.opening):
                return self.joined([self.read_word(w) for w in self.words.findall(chunk.lower())])
        out = []
        for i, part in enumerate(self.specials.split(chunk) if self.specials else [chunk]):
            if i % 2:
                out.append((str(self.ids[part]), self.names[self.ids[part]], self.decode([self.ids[part]])))
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self.read_word, self.words.findall(part))
        return self.joined(out)

    @staticmethod
    def joined(parts: list[tuple[str, str, str]]) -> tuple[str, str, str]:
        """What is known of pieces that follow each other."""
        if len(parts) == 1:
            return parts[0]
        ids, names, texts = zip(*parts) if parts else ((), (), ())
        return " ".join(filter(None, ids)), " ".join(filter(None, names)), "".join(texts)

    def read(self, text: str) -> tuple[str, str, str]:
        """Of a text: its ids joined by spaces, their names joined by spaces, which is what the tokenizers library decodes
        where the file names no decoder, and the text that the state machine gives. No word reaches over white space, so the
        pieces between it are encoded alone; as each of their words ends in the suffix, the state machine is back at its
        beginning after each piece."""
        # \x1c to \x1f split for Python, but are no white space for the vocabulary's pattern
        chunks = text.split() if not regex.search(r"[\x1c-\x1f]", text) else regex.split(r"\p{White_Space}+", text)
        found = list(map(self.known.get, chunks))
        for i in [i for i, made in enumerate(found) if made is None] if None in found else ():
            chunk = chunks[i]
            if (made := self.known.find(chunk)) is None:
                made = self.read_chunk(chunk)
                if len(chunk) <= 100:
                    self.known.keep(chunk, made)
            found[i] = made
        return self.joined(found)

    def encode(self, text: str) -> str:
        """The ids of a text, joined by spaces."""
        return self.read(text)[0]

    def named(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes of the tokens, words followed by a space."""
        return "".join(self.stream(ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete. States: bytes still wanted and bytes held; a byte that can't
        follow gives U+FFFD for those held and begins anew. The text of a token that leads from the beginning back to it is
        remembered."""
        byte_of, complete = self.byte_of, self.complete
        held, want = bytearray(), 0
        for i in ids:
            if not held and i in complete:
                yield complete[i]
                continue
            token, clean = self.names[i], not held
            if token in self.special:
                yield "�" * bool(held) + token
                held, want = bytearray(), 0
                continue
            ends = bool(self.end) and token.endswith(self.end)
            out = []
            for c in token.removesuffix(self.end) if ends else token:
                b = byte_of[c]
                if want and b & 0xC0 != 0x80:
                    out.append("�")
                    held, want = bytearray(), 0
                if want:
                    held.append(b)
                    want -= 1
                    if not want:
                        out.append(held.decode("utf-8", "replace"))
                        held = bytearray()
                elif b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xF4:
                    held, want = bytearray([b]), 1 + (b >= 0xE0) + (b >= 0xF0)
                else:
                    out.append("�")
            if ends:
                out.append("�" * bool(held) + " ")
                held, want = bytearray(), 0
            text = "".join(out)
            if clean and not held:
                complete[i] = text
            yield text
        if held:
            yield "�"


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(source: bytes) -> Tokenizer:
    """One per worker and vocabulary, with what it has learnt about words so far."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(source)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids (array, if asked for), digests of the ids, of what the library decodes them to
    and of the text that the decoding state machine gives (words followed by a space)."""
    source = Path(vocabulary).read_bytes()
    if len(source) > MOST_BYTES:
        raise ValueError(f"{vocabulary} has {len(source)} bytes; at most {MOST_BYTES} are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                joined, named, decoded = tokenizer.read(text.as_py())
                ids = np.array(joined.split(), np.int32) if with_ids else None
                rows.append((joined.count(" ") + bool(joined), ids, sha(joined), sha(named), sha(decoded)))
            n, ids, *digests = zip(*rows) if rows else ((), (), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in digests)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.array([], np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(plain(id_col).alias(id_col), text_or_empty(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, text_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
