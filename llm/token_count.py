"""Token counts by the whole-token shortcut: pre-tokens that are proven to be one token are counted, only the rest is merged.

Before any text is read, the merge list is run on every string of the vocabulary by itself. A string that comes out as one
token is proven whole: wherever the pre-tokenizer cuts out exactly this string, it is one token, whatever stands around it,
as merges never reach over the cuts. Strings that the merge list cannot build (or builds otherwise) are not in the proof and
are merged like any other pre-token. Counting a text is then one look-up for each pre-token; the counts of pre-tokens that
were merged are remembered for a while.

The vocabulary is a JSON file of the tokenizers library with a byte-level model: no normalizer, its usual pattern for
pre-tokens, added tokens found in raw text. Letters and numbers are those of that library's Unicode tables: characters that
the regex module knows as such and the standard library does not are put to the library once. The proof and the merge list are broadcast; they
are bounded by the size of the file, which is refused above MOST_BYTES.

Defined results: a null text counts as the empty text, with no bytes and no tokens; bytes that are no UTF-8 are read as
U+FFFD, but counted as they stand; texts are counted whole, long pre-tokens in n log n; every input row gives a row, repeated
ones and those with a null id too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from llm.bpe import MOST_BYTES, visible_bytes
from llm.shared import plain, text_or_empty

#: Merged pre-tokens whose counts a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 300_000, 100
#: Texts of more characters are cut into pre-tokens one by one instead of all at once.
AT_ONCE = 1 << 20
#: Symbols up to which a pre-token is merged by looking at all neighbours for each merge.
SHORT = 48
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
NEVER = 1 << 60


class MergeList:
    """A merge list over numbered symbols: of two neighbours, the rank of their merge and what it makes."""

    def __init__(self, symbols: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.made = {(symbols[a], symbols[b]): (rank, symbols[a + b]) for rank, (a, b) in enumerate(pairs)}

    def merged(self, parts: list[int]) -> list[int]:
        """Merges applied lowest rank first, of equal ranks leftmost first."""
        return self._few(parts) if len(parts) <= SHORT else self._many(parts)

    def _few(self, parts: list[int]) -> list[int]:
        made, get = self.made, self.made.get
        none = (NEVER, 0)
        ranks = [get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [made[parts[i], parts[i + 1]][1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)[0]
        return parts

    def _many(self, parts: list[int]) -> list[int]:
        made, n = self.made, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in made]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:  # one of the two has been merged since
                continue
            parts[i], parts[j] = made[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := made.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (found[0], i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (found := made.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (found[0], h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]


def unlike_classes(tokenizer: Tokenizer) -> str:
    """Characters that are letters or numbers to the regex module and not to the library, whose tables are older.

    Only characters that the standard library does not know can differ: both others know more than it does.
    """
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    apart = [c for c in newer if len(cut(c + ("a" if regex.match(r"\p{L}", c) else "1"))) > 1]
    return "".join(apart)


def _as_class(chars: str) -> str:
    """A character class body: runs of neighbouring code points as ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _pattern(letters: str, numbers: str, neither: str, space: str, full: str) -> str:
    return rf"{CONTRACTIONS}| ?{letters}+| ?{numbers}+| ?{neither}+|{space}+(?!{full})|{space}+"


class Proof:
    """What is known of a vocabulary before texts are read: strings proven whole, the merge list, the odd characters."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") is not None or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without normalizer and prefix are counted")
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only merge lists over plain bytes are counted")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not counted")
        shown = visible_bytes()
        symbols: dict[str, int] = model["vocab"]
        self.merges = MergeList(symbols, model["merges"])
        self.of_byte = [symbols[c] for c in shown]
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.odd = unlike_classes(Tokenizer.from_buffer(source))
        byte_of = {c: b for b, c in enumerate(shown)}
        self.whole: list[str] = []
        for token, number in symbols.items():
            if self.merges.merged([symbols[c] for c in token]) == [number]:
                try:
                    self.whole.append(bytes(map(byte_of.__getitem__, token)).decode())
                except UnicodeDecodeError:  # half a character is never a pre-token
                    pass


class Counter(dict):
    """Tokens of a pre-token. Those proven whole are in it for good, merged ones for a while."""

    def __init__(self, proof: Proof):
        self.merges, self.of_byte, self.whole = proof.merges, proof.of_byte, dict.fromkeys(proof.whole, 1)
        super().__init__(self.whole)
        self.added = regex.compile("|".join(map(regex.escape, proof.added))) if proof.added else None
        white, other = r"\p{White_Space}", r"\P{White_Space}"
        self.plain = regex.compile(_pattern(r"\p{L}", r"\p{N}", rf"[^{white}\p{{L}}\p{{N}}]", white, other))
        self.odd = frozenset(proof.odd)
        if self.odd:
            odd = f"[{_as_class(proof.odd)}]"
            letters, numbers = rf"[\p{{L}}--{odd}]", rf"[\p{{N}}--{odd}]"
            self.exact = regex.compile(_pattern(letters, numbers, rf"[^{white}{letters}{numbers}]", white, other), regex.V1)
        kinds = {k: _as_class("".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == k)) for k in "LN"}
        space = _as_class("".join(regex.findall(white, bytes(range(256)).decode("latin-1"))))
        self.latin = re.compile(_pattern(f"[{kinds['L']}]", f"[{kinds['N']}]", f"[^{space}{kinds['L']}{kinds['N']}]", f"[{space}]", f"[^{space}]"))

    def __missing__(self, piece: str) -> int:
        of_byte = self.of_byte
        n = len(self.merges.merged([of_byte[b] for b in piece.encode()]))
        if len(piece) <= LONGEST:
            if len(self) >= len(self.whole) + REMEMBERED:
                self.clear()
                self.update(self.whole)
            self[piece] = n
        return n

    def _cutter(self, text: str) -> re.Pattern | regex.Pattern:
        """The cheapest pattern that cuts a text as the library does."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.plain if self.odd.isdisjoint(text) else self.exact
        return self.latin

    def _tally(self, text: str) -> tuple[int, int]:
        """Tokens of a text without added tokens, and how many of them are proven whole."""
        pattern = self._cutter(text)
        if len(text) <= AT_ONCE:
            counts = [self[piece] for piece in pattern.findall(text)]
            return sum(counts), counts.count(1)
        total = whole = 0
        for match in pattern.finditer(text):
            n = self[match.group()]
            total += n
            whole += n == 1
        return total, whole

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a text, and how many of them are pre-tokens proven whole. An added token is one token."""
        if not self.added or not self.added.search(text):
            return self._tally(text)
        total = whole = start = 0
        for match in self.added.finditer(text):
            one, two = self._tally(text[start : match.start()])
            total, whole, start = total + one + 1, whole + two, match.end()
        one, two = self._tally(text[start:])
        return total + one, whole + two


_proofs: dict[str, Proof] = {}
_counters: dict[str, Counter] = {}


def prove(vocabulary: str) -> tuple[str, Proof]:
    """The proof for a vocabulary file and the file's digest; made once in a process."""
    source = Path(vocabulary).read_bytes()
    if len(source) > MOST_BYTES:
        raise ValueError(f"{vocabulary} has {len(source)} bytes; at most {MOST_BYTES} are broadcast")
    digest = hashlib.sha256(source).hexdigest()
    if digest not in _proofs:
        _proofs[digest] = Proof(source)
    return digest, _proofs[digest]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more tokens than the limit), n_whole (tokens that are
    pre-tokens proven whole)."""
    digest, proof = prove(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(proof)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _counters:
            _counters.clear()
            _counters[digest] = Counter(shared.value)
        counter = _counters[digest]
        for batch in batches:
            sizes, tokens, whole = [], [], []
            for cell in batch.column(1):
                raw = cell.as_py()
                n, direct = counter.count(raw.decode("utf-8", "replace"))
                sizes.append(len(raw))
                tokens.append(n)
                whole.append(direct)
            columns = [pa.array(x, pa.int64()) for x in (sizes, tokens, whole)]
            over = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), columns[0], columns[1], over, columns[2]], [id_col, "n_bytes", "n_tokens", "over_limit", "n_whole"])

    rows = docs.select(plain(id_col).alias(id_col), text_or_empty(text_col).cast("binary").alias("raw"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_whole bigint")
