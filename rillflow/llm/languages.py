"""Languages of documents and of their sentences, by code lengths under byte context trees.

Each sentence of a document's prose takes the language in which it is shortest; its confidence is that language's share
of the probabilities 2^-bits, tempered by the number of bytes as neighbouring bytes aren't independent. A sentence whose
best language doesn't stand out, next to others of its document, takes the document's language, that is the one with
the least code length over all prose.

Defined cases: a null, empty or wordless text, and one of only code, links or names of tools, has no language (null,
confidence 0, no segments), nor has one of only a few letters if none stands out; code inside a sentence is cut out of it; very long texts are scored whole, sentences beyond 4,000 characters in parts; an empty table
gives an empty result; without samples there are no languages and an error is raised.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rillflow.llm.ppm import ByteModels
from rillflow.llm.prose import is_short, sentences
from rillflow.plans.sizing import spread_if_few

#: At most so many samples are used for training, a bound on what the driver collects and sends out.
MOST_SAMPLES = 20_000
#: The bounded sample of labelled documents that may be added: so many, none longer than so many characters.
MOST_LABELLED, LONGEST_LABELLED = 6_000, 2_000
OFTEN, AGREED, BELIEVED, PASSES = 3, 0.6, 1.3, 2
#: Bits by which a sentence's language must stand out from its document's language.
STANDS_OUT = 12.0
#: Bits count as so many independent ones.
TEMPER = 0.2
#: Documents judged at once.
BATCH = 1024

#: Codes by three-letter code and English name of languages; fixed values.
NAMED = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr",
    "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt", "ita": "it", "italian": "it", "nld": "nl", "dut": "nl",
    "dutch": "nl", "rus": "ru", "russian": "ru", "jpn": "ja", "japanese": "ja",
}


def without_accents(text: str) -> str:
    spread = unicodedata.normalize("NFD", text)
    # Marks of Cyrillic and kana make other letters and stay.
    kept = [c for i, c in enumerate(spread) if not (unicodedata.combining(c) and i and "LATIN" in unicodedata.name(spread[i - 1], ""))]
    return unicodedata.normalize("NFC", "".join(kept)).replace("ß", "ss")


def normalised(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def train(samples: Sequence[tuple[str, str]], more: Sequence[tuple[str, str]] = ()) -> ByteModels:
    """Models from (language, text), as written and without accents, in the form in which prose is scored.

    more holds texts with labels that may be wrong. A sentence that comes often takes the label that most of its texts
    have; a rare one is used if the models find it shortest in its label's language. PASSES models are made in turn, each
    judging for the next.
    """
    texts: dict[str, list[str]] = {}
    for lang, text in samples:
        for s in sentences(text):
            _add(texts, lang, s)
    if not texts:
        raise ValueError("no labelled samples")
    models = ByteModels(texts)
    votes: dict[str, Counter[str]] = {}
    for lang, text in more:
        for s in sentences(text) if lang in texts else ():
            votes.setdefault(normalised(s), Counter())[lang] += 1
    if not votes:
        return models
    said = sorted(votes)
    for _ in range(PASSES):
        more_texts = {lang: list(own) for lang, own in texts.items()}
        for s, b in zip(said, models.code_lengths(said), strict=True):
            (lang, most), often = votes[s].most_common(1)[0], votes[s].total()
            shortest = models.classes[int(b.argmin())]
            if lang == shortest or (often >= OFTEN and most >= AGREED * often and b[models.classes.index(lang)] <= BELIEVED * b.min()):
                _add(more_texts, lang, s)
        models = ByteModels(more_texts)
    return models


def _add(texts: dict[str, list[str]], lang: str, sentence: str) -> None:
    low = normalised(sentence)
    texts.setdefault(lang, []).append(low)
    bare = without_accents(low)
    if bare != low:
        texts[lang].append(bare)


def bounded_samples(samples: DataFrame, most: int = MOST_SAMPLES) -> list[Row]:
    """At most so many samples: the least hash of each language, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    turns = samples.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").withColumn("turn", turn)
    return sorted(turns.orderBy("turn", "lang").limit(most).select("lang", "text").collect())


def collected_models(samples: DataFrame, documents: DataFrame | None = None) -> ByteModels:
    """Models from the samples and a bounded sample of labelled documents: MOST_LABELLED of least hash, none longer than
    LONGEST_LABELLED characters. Of more than MOST_SAMPLES samples, each language has its equal share, by hash."""
    rows = bounded_samples(samples)
    more = []
    if documents is not None:
        labelled = documents.select("doc_id", label_code(F.col("lang")).alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
        short = labelled.where(F.length("text") <= LONGEST_LABELLED)
        more = short.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).select("lang", "text").collect()
    texts = [(r.lang, r.text) for r in rows], sorted((r.lang, r.text) for r in more)
    key = hashlib.sha256(repr(texts).encode()).hexdigest()
    if key not in _trained:  # models of the same texts are trained once in a program
        _trained.clear()
        _trained[key] = train(*texts)
    return _trained[key]


_trained: dict[str, ByteModels] = {}


def judge(parts: Sequence[Sequence[str]], models: ByteModels) -> list[tuple[list[int], list[float], int, float]]:
    """For each document's sentences: class and confidence of each, class (-1: none) and confidence of the whole. A document
    without language has neither for its sentences."""
    flat = [normalised(s) for p in parts for s in p]
    if not flat:
        return [([], [], -1, 0.0) for _ in parts]
    # Sentences come again and again in a batch; each is scored once.
    place: dict[str, int] = {}
    which = np.array([place.setdefault(s, len(place)) for s in flat])
    bits = models.code_lengths(list(place))[which]
    size = np.array([len(s.encode()) for s in place], dtype=np.float64)[which]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    shortest = bits.argmin(axis=1)
    # A document's language: of the languages its sentences take, the one most bytes take.
    weight = np.zeros((len(parts), bits.shape[1]))
    np.add.at(weight, (doc, shortest), size)
    whole = weight.argmax(axis=1)
    row = np.arange(len(flat))
    least = bits[row, shortest]
    # A few letters tell a language only if it stands out from all others.
    second = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else np.full(len(flat), np.inf)
    told = (second - least >= STANDS_OUT) | ~np.array([is_short(s) for s in flat])
    taken = np.where((bits[row, whole[doc]] - least >= STANDS_OUT) & told, shortest, whole[doc])
    has_any = np.bincount(doc, told, len(parts)) > 0
    shares = np.exp2(-TEMPER * (bits - least[:, None]))
    sure = shares[row, taken] / shares.sum(axis=1)
    share = np.bincount(doc, np.where(taken == whole[doc], sure, 0.0) * size, len(parts)) / np.maximum(np.bincount(doc, size, len(parts)), 1.0)
    out: list[tuple[list[int], list[float], int, float]] = []
    at = 0
    for i, p in enumerate(parts):
        end = at + len(p)
        out.append((taken[at:end].tolist(), sure[at:end].tolist(), int(whole[i]), float(share[i])) if has_any[i] else ([], [], -1, 0.0))
        at = end
    return out


def language_segments(documents: DataFrame, models: ByteModels, label: Column | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, label, lang, confidence, segments(lang, confidence, n_sentences, n_chars).

    A segment is a stretch of successive sentences of one language. label is a string that is carried along.
    """
    sent = documents.sparkSession.sparkContext.broadcast(models)  # bounded by MOST_SAMPLES
    schema = "doc_id bigint, label string, lang string, confidence double, segments array<struct<lang:string,confidence:double,n_sentences:int,n_chars:int>>"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for docs in batches:
            for a in range(0, docs.num_rows, BATCH):
                some = docs.slice(a, BATCH)
                parts = [sentences(t) for t in some.column(1).to_pylist()]
                judged = judge(parts, m)
                languages = [m.classes[whole] if whole >= 0 else None for _, _, whole, _ in judged]
                columns = [some.column(0), some.column(2), pa.array(languages, pa.string()), pa.array([share for *_, share in judged], pa.float64()), _segments(parts, judged, m.classes)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "lang", "confidence", "segments"])

    given = F.lit(None).cast("string") if label is None else label
    return spread_if_few(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", given.alias("label"))).mapInArrow(found, schema)


def _segments(parts: Sequence[Sequence[str]], judged: Sequence[tuple[list[int], list[float], int, float]], names: Sequence[str]) -> pa.ListArray:
    """Of each document its stretches of successive sentences of one language, with their mean confidence."""
    ends, langs, sure, n_sentences, n_chars = [0], [], [], [], []
    for p, (classes, confidence, _, _) in zip(parts, judged, strict=True):
        before = -1
        for s, c, x in zip(p, classes, confidence, strict=False):  # none of a document without language
            if c == before:
                sure[-1] += x
                n_sentences[-1] += 1
                n_chars[-1] += len(s)
            else:
                langs.append(names[c])
                sure.append(x)
                n_sentences.append(1)
                n_chars.append(len(s))
            before = c
        ends.append(len(langs))
    means = np.array(sure) / np.maximum(np.array(n_sentences), 1) if sure else np.empty(0)
    struct = pa.StructArray.from_arrays(
        [pa.array(langs, pa.string()), pa.array(means, pa.float64()), pa.array(n_sentences, pa.int32()), pa.array(n_chars, pa.int32())],
        names=["lang", "confidence", "n_sentences", "n_chars"],
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)


def label_code(label: Column, named: Mapping[str, str] = NAMED) -> Column:
    """The two-letter code a label names, whatever its case, region or notation; null if it names no known language."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    known = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    codes = F.when(plain.isin(*sorted(set(named.values()))), plain)
    return F.coalesce(codes, known[plain])


def mislabelled(documents: DataFrame, models: ByteModels) -> DataFrame:
    """documents(doc_id, text, lang) -> (doc_id, lang) for each language of a document whose label doesn't tell it."""
    seen = language_segments(documents, models, label_code(F.col("lang")))
    langs = F.array_distinct(F.transform("segments", lambda x: x["lang"]))
    judged = seen.select("doc_id", "label", langs.alias("langs"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("langs")[0] != F.col("label"))
    return judged.where((F.size("langs") > 0) & wrong).select("doc_id", F.explode("langs").alias("lang"))
