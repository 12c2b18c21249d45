"""Language of documents and of their blocks: words first, character n-grams as backoff.

A word seen in training scores each language by the negative log of its relative frequency there, with a fixed penalty for
languages that lack it. A word never seen falls back to its padded character n-grams, from the longest length that has a known one
down to single characters, and takes their mean. A text's score is the mean over its words. The model is counted from a bounded sample of
labelled rows; wrong labels among them are removed by scoring the sample with its own model and counting again.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names and codes by which a language is spelled in labels.
SPELLINGS = {
    "en": "en eng english englisch anglais inglés ingles inglês engels английский",
    "de": "de deu ger german deutsch allemand alemán aleman alemão duits немецкий",
    "fr": "fr fra fre french französisch français francais francés frances francês frans французский",
    "es": "es spa spanish spanisch espagnol español espanol castellano espanhol spaans испанский",
    "pt": "pt por portuguese portugiesisch portugais portugués português portugues portugees португальский",
    "nl": "nl nld dut dutch niederländisch néerlandais neerlandés holandés holandês nederlands голландский нидерландский",
    "ru": "ru rus russian russisch russe ruso russo русский",
}
#: Labels that say nothing.
UNKNOWN = "und unk unknown undefined undetermined n/a na none null nil nan mul mis zxx xx xxx any other ? - -- ."
LANGUAGES = tuple(SPELLINGS)
_CODE = {name: code for code, names in SPELLINGS.items() for name in names.split()}

SPAN = re.compile(r"`[^`\n]*`|https?://\S+|\]\([^)\s]*\)|<[^<>\n]{1,80}>")
#: Names of code: flags, dotted, slashed or underscored names, call syntax, camel case.
NAME = re.compile(r"(?<!\w)--?[A-Za-z][\w-]*|\S*\w[._/\\=(){}\[\]$@#]+\w\S*|\b\w*_\w*\b|\b[^\W\d]*[^\W\d_A-Z][A-Z]\w*\b")
LETTERS = re.compile(r"[^\W\d_]+")
ANY_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LanguageParams:
    """Rows a language the model is counted from (chosen by hash, so anywhere in the table), and characters read of each."""

    sample_rows: int = 400
    sample_chars: int = 4000
    longest_gram: int = 5
    penalty: float = 7.0
    rounds: int = 2
    least_words: int = 8
    own_weight: float = 1.5  # ln of the odds a block is given for its document's main language


def clean(text: str) -> str:
    return NAME.sub(" ", SPAN.sub(" ", text))


def prose_words(text: str) -> list[str]:
    return LETTERS.findall(clean(text).lower())


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Score rows (7 values, lower is better) of known words and n-grams; unseen words are scored on demand."""

    def __init__(self, counts: dict[str, Counter], params: LanguageParams):
        self.p = params
        self.words = self._table(counts)
        self.by_gram = {}
        for n in range(1, params.longest_gram + 1):
            per = {lang: Counter() for lang in counts}
            for lang, words in counts.items():
                for w, k in words.items():
                    for g in grams(w, n):
                        per[lang][g] += k
            self.by_gram[n] = self._table(per)
        self.memo: dict[str, np.ndarray] = {}

    def _table(self, counts: dict[str, Counter]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for i, lang in enumerate(LANGUAGES):
            total = sum(counts.get(lang, {}).values()) or 1
            for f, k in counts.get(lang, {}).items():
                if f not in out:
                    out[f] = np.full(len(LANGUAGES), self.p.penalty)
                out[f][i] = min(self.p.penalty, -math.log10(k / total))
        return out

    def row(self, word: str) -> np.ndarray | None:
        if (r := self.words.get(word)) is not None:
            return r
        if word not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = self._backoff(word)
        return self.memo[word]

    def _backoff(self, word: str) -> np.ndarray | None:
        for n in range(min(self.p.longest_gram, len(word) + 2), 0, -1):
            table = self.by_gram[n]
            if known := [table[g] for g in grams(word, n) if g in table]:
                return np.mean(known, axis=0)
        return None

    def total(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Sum of scores and number of words scored."""
        rows = [r for w in words if (r := self.row(w)) is not None]
        return (np.sum(rows, axis=0), len(rows)) if rows else (np.zeros(len(LANGUAGES)), 0)


def confidence(total: np.ndarray, n: int, bonus: np.ndarray | None = None) -> tuple[int, float]:
    """Best language and its posterior. Words of a text are not independent, so their evidence counts by the square root of their number."""
    z = -total * math.log(10) / math.sqrt(max(n, 1))
    if bonus is not None:
        z = z + bonus
    e = np.exp(z - z.max())
    return int(z.argmax()), float(e.max() / e.sum())


@dataclass
class Block:
    number: int
    text: str
    prose: bool


def blocks(text: str, least_words: int) -> list[Block]:
    """All blocks between blank lines; `prose` is off for fences, tables, headings and blocks of few words."""
    out: list[Block] = []
    fence = ""
    for part in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text.replace("\r\n", "\n").replace("\r", "\n").strip("\n")):
        if not part.strip():
            continue
        lines = part.split("\n")
        code = bool(fence)
        kept = []
        for line in lines:
            m = re.match(r"[ >]{0,6}(`{3,}|~{3,})", line)
            if m:
                code = True
                if not fence:
                    fence = m.group(1)
                elif m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                    fence = ""
            elif not fence:
                kept.append(line)
        table = all(x.lstrip().startswith("|") for x in lines)
        heading = all(re.match(r"\s{0,3}#{1,6}(\s|$)", x) for x in lines)
        if code and kept:  # prose right beside a fence, without a blank line
            code = len(ANY_WORD.findall(" ".join(kept))) < least_words
        prose = not (code or table or heading) and len(ANY_WORD.findall(part)) >= least_words
        out.append(Block(len(out), "\n".join(kept) if kept else part, prose))
    return out


def label_code(label: Column) -> Column:
    """The stated language: a two-letter code, 'none' where the label is null or says nothing, 'other' for any other language."""
    plain = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    head = F.regexp_extract(plain, r"^([^-_\s(,;/]+)", 1)
    names = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])
    return (
        F.when(label.isNull() | (plain == "") | plain.isin(*UNKNOWN.split()), "none")
        .when(F.element_at(names, plain).isNotNull(), F.element_at(names, plain))
        .when(F.element_at(names, head).isNotNull(), F.element_at(names, head))
        .otherwise("other")
    )


def train(docs: DataFrame, doc_id: str, text: str, label: str, params: LanguageParams = LanguageParams()) -> Model:
    """A model from at most `sample_rows` rows for each language, by least hash of id, and `rounds` of relabelling."""
    p = params
    rows = docs.select(F.xxhash64(F.col(doc_id)).alias("h"), F.substring(F.col(text).cast("string"), 1, p.sample_chars).alias("text"), label_code(F.col(label).cast("string")).alias("code")).where(F.col("code").isin(*LANGUAGES) & (F.length("text") > 0))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).where(F.col("r") <= p.sample_rows)  # bounded: languages x sample_rows
    units: list[tuple[str, list[str]]] = []
    for r in ranked.select("code", "text").orderBy("code", "r").collect():
        bs = [b.text for b in blocks(r["text"], p.least_words) if b.prose] or [r["text"]]
        units.extend((r["code"], w) for b in bs if (w := prose_words(b)))
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, words in units:
        counts[lang].update(words)
    for _ in range(p.rounds):
        model = Model(counts, p)
        counts = defaultdict(Counter)
        for lang, words in units:
            total, n = model.total(words)
            best, sure = confidence(total, n)
            if n and sure > 0.9:
                counts[LANGUAGES[best]].update(words)
    return Model(counts, p)


def segment(text: str | None, model: Model, p: LanguageParams) -> list[tuple[int, str, float]]:
    """(segment_no, language, confidence): segment -1 is the whole document, then each prose block. Empty for a text without words."""
    if not text:
        return []
    bs = [b for b in blocks(text, p.least_words) if b.prose]
    scored = [(b.number, *model.total(prose_words(b.text))) for b in bs]
    scored = [x for x in scored if x[2]]
    if not scored:
        total, n = model.total(prose_words(re.sub(r"(?ms)^[ >]*(`{3,}|~{3,}).*?^[ >]*\1", " ", text)))
        if not n:
            return []
        best, sure = confidence(total, n)
        return [(-1, LANGUAGES[best], sure)]
    total, n = sum(x[1] for x in scored), sum(x[2] for x in scored)
    main, sure = confidence(total, n)
    bonus = np.zeros(len(LANGUAGES))
    bonus[main] = p.own_weight
    out = []
    for number, t, k in scored:
        best, s = confidence(t, k, bonus)
        out.append((number, LANGUAGES[best], s))
    return [(-1, LANGUAGES[main], sure), *out]


def detect(docs: DataFrame, doc_id: str, text: str, label: str, model: Model, params: LanguageParams = LanguageParams()) -> DataFrame:
    """One row a document (segment_no -1) and prose block: doc_id, segment_no, language, confidence, stated, mixed.

    `stated` is the label's language ('none', 'other'); `mixed` tells whether the document's prose blocks differ in language. Every block
    between blank lines gets a number; fences, tables, headings and blocks of fewer than `least_words` words get no row. A null
    or wordless text gives no row; labels may be null or odd; repeated ids give repeated rows; other columns are ignored.
    """
    p = params
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = dict(docs.dtypes)[doc_id]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in it:
            out = []
            for item, body, stated in zip(pdf["doc_id"], pdf["text"], pdf["stated"], strict=True):
                rows = segment(body, m, p)
                mixed = len({lang for no, lang, _ in rows if no >= 0}) > 1
                out.extend((item, no, lang, sure, stated, mixed) for no, lang, sure in rows)
            yield pd.DataFrame(out, columns=["doc_id", "segment_no", "language", "confidence", "stated", "mixed"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), label_code(F.col(label).cast("string")).alias("stated")).mapInPandas(run, f"doc_id {kind}, segment_no bigint, language string, confidence double, stated string, mixed boolean")


def relabel(docs: DataFrame, doc_id: str, text: str, label: str, params: LanguageParams = LanguageParams()) -> DataFrame:
    """`detect` with a model trained on the table's own labels."""
    return detect(docs, doc_id, text, label, train(docs, doc_id, text, label, params), params)


def corrections(found: DataFrame) -> DataFrame:
    """What labels lack: the language of one-language documents whose label is missing or wrong, and every segment of mixed ones."""
    return found.where(F.when(F.col("mixed"), F.col("segment_no") >= 0).otherwise((F.col("segment_no") == -1) & (F.col("stated") != F.col("language")))).select("doc_id", "segment_no", "language")
