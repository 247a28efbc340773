"""Exact token counts of every prefix of a text, for a BPE vocabulary with word ends.

A text's tokens are its words' tokens, so a prefix holds the tokens of the whole words before it and those of one word's
prefix. Within a word a dynamic program over prefixes gives both. Let last[i] be the last token of the encoding of the
first i symbols when the word goes on, and ends[i] the number of tokens when it ends there. The encoding of a prefix is
the encoding of a shorter prefix plus one token, and just one token is compatible: the pair (last token before, this
token) must survive undoing the merges of both in reverse order of rank, without meeting a merge that would have crossed
the border earlier. So one pass finds last, its count and ends for all prefixes; nothing is encoded again for another
length.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, documents, schema_with, workers_see_package
from .words import sliced


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class PrefixCounter:
    """Prefix token counts for a tokenizer file: BPE with an end-of-word suffix, lower case, white space dropped."""

    #: White space for Python that is none for the tokenizer.
    ODD_SPACE = regex.compile("[\x1c-\x1f]")
    #: White space for the tokenizer.
    BLANK = r"\t-\r \x85\xa0  -     　"
    SPACE = regex.compile(f"[{BLANK}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = {}  # tokens within a word
        self.final: dict[str, int] = {}  # tokens at its end, without the suffix
        for token, i in model["vocab"].items():
            if token.endswith(suffix) and len(token) > len(suffix):
                self.final[token[: -len(suffix)]] = i
            else:
                self.vocab[token] = i
        ids = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            token = ids[a + b]
            self.merged.setdefault((ids[a], ids[b]), rank)
            if token not in self.rank:
                self.rank[token], self.parts[token] = rank, (ids[a], ids[b])
        self.longest = max(map(len, [*self.vocab, *self.final]))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", self.BLANK))
        self.letters = byte_letters()
        self.good: dict[int, bool] = {}
        self.chunks: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        # finds all tokens that end at a place, the longest first; a blank after a word marks its end
        if self.longest > 126 or max(ids.values()) >= 1 << 23:
            raise ValueError("tokens or ids too long for the finder's 32-bit values")
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for shown, end in ((self.vocab, ""), (self.final, " ")):
            for token, i in shown.items():
                self.finder.add_word(token + end, i << 8 | len(token + end) << 1 | bool(end))
        self.finder.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b stays apart from token a before it."""
        key = a << 32 | b
        known = self.good.get(key)
        if known is None:
            known = self.good[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo the latest merge of either side, again and again. A merge across the border happens if its rank is below
        # those of the merges undone so far; of equal ranks the leftmost comes first, so the right side is undone first.
        limit, rank, after = (1 << 60, 0), self.rank, self.merged.get((a, b))
        while True:
            if after is not None and (after, 1) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = (ra, 0), self.parts[a][1]
            else:
                limit, b = (rb, 2), self.parts[b][0]
            after = self.merged.get((a, b))

    def letters_of(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))

    def word_prefixes(self, word: str) -> list[int]:
        """Token counts of the word's prefixes, by byte, from the empty one on."""
        return self._program(self.letters_of(word))

    def _program(self, w: str) -> list[int]:
        n, longest, vocab, final = len(w), self.longest, self.vocab, self.final
        last, count, ends = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            inner = outer = False
            for start in range(max(0, i - longest), i):
                piece, before = w[start:i], last[start]
                if not inner:
                    t = vocab.get(piece)
                    if t is not None and (start == 0 or self.compatible(before, t)):
                        last[i], count[i], inner = t, count[start] + 1, True
                if not outer:
                    t = final.get(piece)
                    if t is not None and (start == 0 or self.compatible(before, t)):
                        ends[i], outer = count[start] + 1, True
                if inner and outer:
                    break
        return ends

    def _counts(self, words: list[str]) -> list[int]:
        """Tokens of each word: the program over the prefixes of all of them in one pass, of which only the last entries are kept."""
        joined = " ".join(map(self.letters_of, words)) + " "
        last, count = [-1] * (len(joined) + 1), [0] * (len(joined) + 1)
        good, compatible, done, out = self.good, self.compatible, -1, []
        for end, found in self.finder.iter(joined):
            if end == done:  # a longer token is known already
                continue
            start = end + 1 - ((found & 0xFF) >> 1)
            before, t = last[start], found >> 8
            if before < 0 or (good[key] if (key := before << 32 | t) in good else compatible(before, t)):
                done = end
                if found & 1:
                    out.append(count[start] + 1)
                else:
                    last[end + 1], count[end + 1] = t, count[start] + 1
        return out

    def normal(self, text: str) -> str:
        """As the tokenizer's normalizer does; code points as they count for prefixes."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def _spaced(self, text: str) -> list[str]:
        return text.split() if not self.ODD_SPACE.search(text) else [x for x in self.SPACE.split(text) if x]

    def _spans(self, text: str) -> list[tuple[int, int]]:
        """Where the chunks of _spaced lie."""
        cuts = [0, *(x for m in self.SPACE.finditer(text) for x in m.span()), len(text)]
        return [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if b > a]

    def segments(self, text: str) -> list[str]:
        """Normalised stretches between special tokens."""
        return [self.normal(x) for x in (self.special.split(text) if "<|" in text else [text])]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return self.counted(text)[0]

    def counted(self, text: str) -> tuple[int, int]:
        """Tokens and code points of the whole normalised text."""
        parts = self.segments(text)
        tokens = len(parts) - 1 + sum(sum(self.chunk_counts(p)) for p in parts)
        return tokens, sum(map(len, parts)) + (_special_chars(self, text) if len(parts) > 1 else 0)

    def chunk_counts(self, segment: str) -> list[int]:
        known = self.chunks
        chunks = self._spaced(segment)
        try:
            return list(map(known.__getitem__, chunks))
        except KeyError:
            pass
        for cache, most in ((known, CACHE_ENTRIES), (self.whole, CACHE_ENTRIES), (self.good, 4 * CACHE_ENTRIES)):
            if len(cache) > most:
                cache.clear()
        whole, split = self.whole, self.words.findall
        new = [(c, (c,) if c.isascii() and c.isalpha() else split(c)) for c in set(chunks).difference(known)]
        words = list({w for _, ws in new for w in ws}.difference(whole))
        if words:
            whole.update(zip(words, self._counts(words), strict=True))
        known.update((c, sum(map(whole.__getitem__, ws))) for c, ws in new)
        return list(map(known.__getitem__, chunks))

    def prefix_counts(self, segment: str) -> np.ndarray:
        """Token counts of all prefixes of a normalised stretch, by code point: element i counts segment[:i]."""
        out = np.zeros(len(segment) + 1, np.int32)
        done = at = 0
        for m in self.words.finditer(segment):
            out[at : m.start() + 1] = done
            counts = self.word_prefixes(m[0])
            ends = np.cumsum([len(c.encode()) for c in m[0]])
            out[m.start() + 1 : m.end() + 1] = done + np.array(counts, np.int32)[ends]
            done, at = done + counts[-1], m.end()
        out[at:] = done
        return out

    def all_prefixes(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of the whole normalised text; a special string counts from its last character on."""
        parts = self.segments(text)
        specials = self.special.findall(text) if len(parts) > 1 else []
        out, done = [np.zeros(1, np.int32)], 0
        for k, part in enumerate(parts):
            out.append(self.prefix_counts(part)[1:] + done)
            done = int(out[-1][-1]) if len(part) else done
            if k < len(specials):
                jump = np.full(len(specials[k]), done, np.int32)
                jump[-1] = done = done + 1
                out.append(jump)
        return np.concatenate(out)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the normalised text's longest prefix up to which every prefix has at most `budget` tokens.

        A special token counts whole or not at all. Whole chunks are skipped by their counts; only the chunk in which
        the budget ends is looked into.
        """
        used = chars = 0
        parts = self.segments(text)
        specials = self.special.findall(text) if len(parts) > 1 else []
        for k, part in enumerate(parts):
            sums = list(accumulate(self.chunk_counts(part)))
            if used + (sums[-1] if sums else 0) > budget:
                fits = bisect_right(sums, budget - used)
                used += sums[fits - 1] if fits else 0
                start, end = self._spans(part)[fits]
                counts = self.prefix_counts(part[start:end])
                over = np.flatnonzero(counts > budget - used)
                return chars + start + int(over[0]) - 1
            used += sums[-1] if sums else 0
            chars += len(part)
            if k < len(specials):
                if used + 1 > budget:
                    return chars
                used, chars = used + 1, chars + len(specials[k])
        return chars


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, tokenizer: str, budget: int = 2048, prefixes: bool = False) -> DataFrame:
    """df (text string, others kept) with n_tokens, n_fitting_chars and, if asked for, prefix_tokens.

    n_tokens is the tokenizer's count for the whole text, without added special tokens; special strings in the text count
    as the one token they stand for. n_fitting_chars: code points of the normalised text that fit into `budget` tokens.
    prefix_tokens (array<int>): the count of every prefix of the normalised text by code point; a special string counts
    from its last character on. A null text counts as empty: 0 tokens. Repeated rows count alike; a word of
    any length is one program, linear in its characters. An empty df gives no rows. Columns of df with these names are
    replaced. `tokenizer` names a file of public_tokenizers or is a path that executors can open.
    """
    workers_see_package(df.sparkSession)
    df = df.drop("n_tokens", "n_fitting_chars", "prefix_tokens")
    at = df.schema.fieldNames().index("text")
    schema = schema_with(df, "n_tokens long, n_fitting_chars long" + ", prefix_tokens array<int>" * prefixes)

    def count(batches):
        c = counter(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        for b in (part for whole in batches for part in sliced(whole, at)):
            texts = [x or "" for x in b.column(at).to_pylist()]
            counted = [c.counted(x) for x in texts]
            n = [k for k, _ in counted]
            fits = [chars if k <= budget else c.longest_prefix(x, budget) for x, (k, chars) in zip(texts, counted, strict=True)]
            new = [pa.array(n, pa.int64()), pa.array(fits, pa.int64())]
            if prefixes:
                new.append(pa.array([c.all_prefixes(x).tolist() for x in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.fieldNames())

    return df.mapInArrow(count, schema)


def _special_chars(c: PrefixCounter, text: str) -> int:
    return sum(map(len, c.special.findall(text))) if "<|" in text else 0


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = token_counts(docs, "word_bpe_49k.json", 2048)
    return out.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"), "n_fitting_chars",
    )


def token_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_prefix_token_counts that SQL can state."""
    return op6_prefix_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


#: DuckDB: the rows of token_byte_counts.
OP6_BYTES_SQL = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents"
