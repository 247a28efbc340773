"""Text analytics as column expressions."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Filler patterns, in order of preference.
FILLERS = [
    r"\bum+\b", r"\buh+\b", r"\berm+\b", r"\blike\b", r"\byou know\b", r"\bi mean\b", r"\bsort of\b", r"\bkind of\b",
    r"\bbasically\b", r"\bactually\b", r"\bliterally\b", r"\bright\?",
]

# Words of each category.
LEXICONS = {
    "cognitive_process": [
        "think", "thought", "thinking", "know", "knew", "knowing", "knowledge", "understand", "understood",
        "understanding", "realize", "realized", "consider", "considered", "remember", "recall", "decide", "decided",
        "reason", "reasoning", "analyze", "analyzed",
    ],
    "tentative": [
        "maybe", "perhaps", "possibly", "might", "could", "may", "seems", "seem", "seemed", "appears", "appear",
        "guess", "suppose", "probably", "somewhat", "approximately", "around", "roughly",
    ],
    "certainty": [
        "always", "never", "definitely", "certainly", "must", "absolutely", "clearly", "obviously", "undoubtedly",
        "completely", "totally", "entirely", "fully", "exactly", "precisely",
    ],
    "inclusive": [
        "and", "with", "also", "together", "both", "include", "including", "plus", "additionally", "furthermore",
        "moreover",
    ],
    "exclusive": [
        "but", "except", "without", "however", "though", "although", "unless", "rather", "instead", "neither", "nor",
        "exclude", "excluding",
    ],
    "insight": [
        "realize", "realized", "understand", "understood", "see", "notice", "noticed", "discover", "discovered",
        "recognize", "recognized", "aware", "awareness",
    ],
    "causation": [
        "because", "cause", "caused", "causes", "why", "since", "therefore", "thus", "hence", "consequently",
        "result", "resulted", "leads", "led", "due", "reason", "effect",
    ],
}

# Title patterns in order, with type and confidence; only the second minds case.
TITLES = [
    (r"(?iU)\bbuild\s*lab\b", "community", 0.95),
    (r"(?U)\bhappy\s*hour\b|\bHH\b", "community", 0.95),
    (r"(?iU)\bcohort\b|\bcommunity\b", "community", 0.90),
    (r"(?iU)\bhuddle\b", "huddle", 0.95),
    (r"(?iU)\bstand[\s-]?up\b", "huddle", 0.90),
    (r"(?iU)\bworkshop\b", "workshop", 0.90),
    (r"(?iU)\btraining\b|\bonboarding\b", "training", 0.90),
    (r"(?iU)\bintro\s*(call)?\b", "discovery", 0.85),
    (r"(?iU)\bdiscovery\b", "discovery", 0.90),
    (r"(?iU)\bdemo\b", "demo", 0.90),
    (r"(?iU)\bretro\b|\bretrospective\b", "retro", 0.90),
    (r"(?iU)\bbrainstorm\b", "brainstorm", 0.90),
    (r"(?iU)\binterview\b", "interview", 0.85),
    (r"(?iU)\bpitch\b|\bproposal\b|\bclosing\b", "sales", 0.85),
    (r"(?iU)\bfireside\b|\bpanel\b|\bbriefing\b", "demo", 0.80),
]

# Phrases that hint at a type, in order of declaration.
HINTS = {
    "discovery": ["tell me about", "walk me through", "what does", "how does", "could you explain", "what are you looking for", "what's the challenge"],
    "demo": ["let me show you", "as you can see", "this feature", "the demo", "share my screen"],
    "status": ["update on", "since last", "blocked on", "this week", "next steps", "action items"],
    "retro": ["went well", "didn't go well", "what we learned", "next time", "post-mortem"],
    "brainstorm": ["what if", "could we", "another idea", "wild idea", "throw out"],
    "interview": ["tell me about a time", "your experience", "your background", "why are you"],
    "huddle": ["quick sync", "let's go around", "what's everyone working on", "any blockers", "before we wrap", "good to go"],
    "workshop": ["let's build", "let's work through", "open your", "follow along", "hands on", "breakout", "exercise"],
    "sales": ["pricing", "proposal", "contract", "next steps to move forward", "decision maker", "budget", "timeline to sign"],
    "training": ["today we'll cover", "learning objective", "module", "quiz", "take notes"],
}


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it, also inside its own lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fillers(text: Column) -> Column:
    """Fillers of the text in order, in lower case."""
    found = F.regexp_extract_all(text, F.lit("(?iU)(" + "|".join(FILLERS) + ")"), F.lit(1))
    return F.transform(found, F.lower)


def lexical_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\b[\w']+\b)"), F.lit(1)), F.lower)


def linguistic(text: Column) -> Column:
    """Struct of word_count and the number of tokens in each category (bigint)."""
    inside = lambda t, words: F.size(F.filter(t, lambda x: x.isin(words)))

    def counts(t: Column) -> Column:
        each = [inside(t, words).cast("bigint").alias(k) for k, words in LEXICONS.items()]
        return F.struct(F.size(t).cast("bigint").alias("word_count"), *each)

    return let(lexical_tokens(text), counts)


def title_type(title: Column) -> Column:
    """Struct (meeting_type, confidence) of the first pattern that a title has; null if none."""
    out = None
    for pattern, kind, confidence in TITLES:
        value = F.struct(F.lit(kind).alias("meeting_type"), F.lit(confidence).alias("confidence"))
        out = F.when(title.rlike(pattern), value) if out is None else out.when(title.rlike(pattern), value)
    return out


def hint_count(text: Column, phrases: list[str]) -> Column:
    """Occurrences of the phrases in lower-case text, each phrase by itself without overlap."""
    return sum((F.regexp_count(text, F.lit(re.escape(p).replace("\\ ", " ").replace("\\-", "-"))) for p in phrases), F.lit(0))


def meeting_types(segments: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """meeting_type and confidence of each transcript; a title (transcript_id, title), if given, decides first."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    s = segments.groupBy("transcript_id").agg(F.lower(joined).alias("t"), F.count_distinct("speaker_id").alias("n"))
    s = s.select("transcript_id", "n", *[hint_count(F.col("t"), p).alias(k) for k, p in HINTS.items()])
    top = F.greatest(*HINTS)
    best = F.coalesce(*[F.when(F.col(k) == top, F.lit(k)) for k in HINTS])
    value = lambda k, c: F.struct(k.alias("meeting_type"), c.cast("double").alias("confidence"))
    verdict = (
        F.when((F.col("n") == 2) & (F.col("interview") >= 2), value(F.lit("interview"), F.lit(0.7)))
        .when((F.col("n") == 2) & (top < 3), value(F.lit("one_on_one"), F.lit(0.5)))
        .when((F.col("n") >= 4) & (top < 3), value(F.lit("huddle"), F.lit(0.4)))
        .when(top >= 5, value(best, F.least(F.lit(0.4) + F.lit(0.05) * top, F.lit(0.85))))
        .otherwise(value(F.lit("unknown"), F.lit(0.0)))
    )
    if titles is None:
        return s.select("transcript_id", verdict.alias("v")).select("transcript_id", "v.*")
    s = titles.join(s, "transcript_id", "left")
    none = value(F.lit("unknown"), F.lit(0.0))
    v = F.coalesce(title_type(F.col("title")), F.when(F.col("n").isNull(), none).otherwise(verdict))
    return s.select("transcript_id", v.alias("v")).select("transcript_id", "v.*")


def signature_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def shingles(tokens: Column, size: int = 4) -> Column:
    def runs(t: Column) -> Column:
        n = F.size(t)
        several = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, size), " "))
        return F.when(n <= size, F.array(F.array_join(t, " "))).otherwise(several)

    return let(tokens, runs)


@F.pandas_udf(T.StringType())
def text_signature(text: pd.Series) -> pd.Series:
    """64-bit SimHash (hexadecimal) of tokens and 4-token shingles by 8-byte BLAKE2b; null below six tokens.

    Features count as often as they come; a tie sets the bit.
    """

    out: list[str | None] = [None] * len(text)
    held: list[tuple[int, int]] = []  # (place of a text, number of its features) of the texts that digests holds
    digests: list[bytes] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
            sizes = np.array([n for _, n in held])
            ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int64)
            signatures = np.packbits(2 * ones >= sizes[:, None], axis=1)
            for (i, _), s in zip(held, signatures, strict=True):
                out[i] = s.tobytes().hex()
        held.clear()
        digests.clear()

    for i, x in enumerate(text):
        t = re.findall("[a-z0-9]+", x.lower()) if x is not None else []
        if len(t) >= 6:
            features = t + [" ".join(t[j : j + 4]) for j in range(len(t) - 3)]
            digests += [hashlib.blake2b(w.encode(), digest_size=8).digest() for w in features]
            held.append((i, len(features)))
        if len(digests) > 200_000:
            flush()
    flush()
    return pd.Series(out, dtype=object)


def md5_signatures(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, simhash): as text_signature, with the first 64 bits of MD5 in place of BLAKE2b, in built-in functions only.

    Each bit is a sum over a text's features, so texts are aggregated before they are dealt. key: unique.
    """
    t = df.select(key, signature_tokens(F.col(text)).alias("t")).where(F.size("t") >= 6)
    features = t.select(key, F.explode(F.concat("t", shingles(F.col("t")))).alias("f"))
    bits = features.select(key, F.conv(F.left(F.md5(F.col("f").cast("binary")), F.lit(16)), 16, -10).cast("bigint").alias("h"))
    one = lambda i: F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)))
    sums = bits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[one(i).alias(f"b{i}") for i in range(64)])
    half = lambda lo: reduce(Column.__add__, [F.when(2 * F.col(f"b{lo + i}") >= F.col("n"), 1 << i).otherwise(0).cast("bigint") for i in range(32)])
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    found = sums.select(key, F.concat(digits(half(32)), digits(half(0))).alias("simhash"))
    return df.select(key).join(found, key, "left")


def hamming_hex(a: Column, b: Column) -> Column:
    signed = lambda x: F.conv(x, 16, -10).cast("bigint")
    return F.bit_count(signed(a).bitwiseXOR(signed(b)))


def timestamp(ms: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def safe_stem(text: Column, fallback: str = "audio") -> Column:
    """At most 160 letters, digits, dots, underscores and dashes; never empty."""
    s = F.left(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), F.lit(".-")), F.lit(160))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def stable_id(text: Column) -> Column:
    return F.left(F.sha1(text.cast("binary")), F.lit(16))


# --- search -----------------------------------------------------------------------------------------------------------


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


class _Query:
    """AND, OR, NOT, parentheses, "phrases" and prefixes*; words side by side mean AND."""

    TOKEN = re.compile(r'"[^"]*"|\(|\)|[^\s()"]+')

    def __init__(self, text: str):
        self.parts = [] if text.count('"') % 2 else self.TOKEN.findall(text)
        self.terms: list[str] = []

    def parse(self, t: Column) -> Column:
        if not self.parts:
            raise ValueError("malformed search query")
        out = self._or(t)
        if self.parts:
            raise ValueError(f"malformed search query near {self.parts[0]!r}")
        return out

    def _or(self, t: Column) -> Column:
        out = self._and(t)
        while self.parts and self.parts[0] == "OR":
            self.parts.pop(0)
            out = out | self._and(t)
        return out

    def _and(self, t: Column) -> Column:
        out = self._one(t)
        while self.parts and self.parts[0] not in ("OR", ")"):
            if self.parts[0] == "AND":
                self.parts.pop(0)
                out = out & self._one(t)
            elif self.parts[0] == "NOT":
                self.parts.pop(0)
                out = out & ~self._one(t)
            else:
                out = out & self._one(t)
        return out

    def _one(self, t: Column) -> Column:
        if not self.parts:
            raise ValueError("malformed search query: it ends too early")
        part = self.parts.pop(0)
        if part == "(":
            out = self._or(t)
            if not self.parts or self.parts.pop(0) != ")":
                raise ValueError("malformed search query: no closing parenthesis")
            return out
        if part in (")", "AND", "OR", "NOT"):
            raise ValueError(f"malformed search query near {part!r}")
        words = re.findall(r"[^\W_]+", part.lower())
        if not words:
            raise ValueError(f"malformed search query near {part!r}")
        self.terms += words[:1]
        prefix = part.endswith("*")
        line = F.concat(F.lit(" "), F.array_join(t, " "), F.lit("" if prefix else " "))
        return line.contains(" " + " ".join(words) + ("" if prefix else " "))


def search(segments: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """transcript_id, segment_id, speaker_id, snippet of matching segments by (transcript_id, seq).

    The snippet marks the query's first words with << >> and shows at most 16 tokens from the first hit on.
    """
    q = _Query(query)
    hit = q.parse(search_tokens(F.col("text")))
    terms = F.array(*map(F.lit, dict.fromkeys(q.terms)))
    found = segments.where(hit).withColumn("w", F.split("text", r"\s+"))
    bare = lambda x: F.element_at(F.concat(search_tokens(x), F.array(F.lit(""))), 1)
    is_term = lambda x: F.exists(terms, lambda t: bare(x).startswith(t))
    first = F.coalesce(F.array_min(F.transform("w", lambda x, i: F.when(is_term(x), i))), F.lit(0))
    start = F.greatest(first - 3, F.lit(0))
    shown = F.transform(F.slice("w", start + 1, 16), lambda x: F.when(is_term(x), F.concat(F.lit("<<"), x, F.lit(">>"))).otherwise(x))
    snippet = F.concat(
        F.when(start > 0, F.lit("...")).otherwise(""), F.array_join(shown, " "), F.when(start + 16 < F.size("w"), F.lit("...")).otherwise("")
    )
    out = found.select("transcript_id", "seq", "segment_id", "speaker_id", snippet.alias("snippet"))
    return out if limit is None else out.orderBy("transcript_id", "seq").limit(limit)
