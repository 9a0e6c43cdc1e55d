"""Languages of documents and paragraphs by segmentation-marginalised unigrams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from .bpe import TOKENIZERS

LANGUAGES = ("de", "en", "es", "fr", "ja", "pt", "zh")
#: Labels of three letters and names, to the two-letter code.
LABELS = {
    "eng": "en", "english": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "jpn": "ja", "jp": "ja", "japanese": "ja", "deu": "de", "ger": "de", "german": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt",
}
#: Parts of a text that are of no language: tags, addresses, calls and subscripts with what they enclose.
NEUTRAL = re.compile(
    r"<[^<>\n]{1,40}>|https?://\S+"
    r"|[A-Za-z_][A-Za-z0-9_.]*+(?=[\[(])(?:\((?:[^()\n]|\((?:[^()\n]|\((?:[^()\n]|\([^()\n]*\))*\))*\))*\)|\[[^\]\n]*\]|\.[A-Za-z_][A-Za-z0-9_]*)+"
)
#: Exchange suffixes of tickers, of no language either.
EXCHANGES = frozenset(("SH", "SZ", "BJ", "XSHG", "XSHE"))
UNSPACED = "\u3005\u3006\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003134f"
#: A run of unspaced script, a word (with digits and underscores, which mark it as a name), or a letter of another script.
UNIT = re.compile(f"[{UNSPACED}]+|[A-Za-z0-9_\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]+|[^\\W\\d_]")
SPACED = re.compile(f"[{UNSPACED}]")
#: Units a worker keeps scored before it starts afresh (memory bound; results don't depend on it).
CACHE = 200_000


def label_language(label: str | None) -> str | None:
    """The language a label names, however spelled; None if it is missing or names none."""
    t = (label or "").strip().casefold().replace("_", "-")
    t = LABELS.get(t, t)
    t = LABELS.get(t.split("-")[0], t.split("-")[0])
    return t if len(t) == 2 and t.isascii() and t.isalpha() else None


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs parted by blank lines (any line end), in order; none of a null or blank text."""
    out: list[list[str]] = [[]]
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(p) for p in out if p]


def units(text: str) -> list[str]:
    """The words and unspaced runs of a text that belong to some language, as written."""
    if "(" in text or "[" in text or "<" in text or "://" in text:
        text = NEUTRAL.sub(" ", text)
    return [u for u in UNIT.findall(text) if u.isalpha() and u not in EXCHANGES]


class Pieces:
    """A fixed public vocabulary: every way to cut a unit into its pieces, bytes for unknown characters."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "piece_bpe_32k"):
        sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
        self.size = sp.get_piece_size()
        self.automaton, self.bytes, chars = ahocorasick.Automaton(), np.zeros(256, np.int64), set()
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.automaton.add_word(p, (len(p), i))
                if len(p) == 1:
                    chars.add(p)
        self.automaton.make_automaton()
        self.chars = chars

    def lattice(self, unit: str) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
        """Length and arcs (from, to, piece ids) of a unit, ordered by their end."""
        s = unit if SPACED.match(unit) else "▁" + unit
        arcs = [(end + 1 - n, end + 1, (i,)) for end, (n, i) in self.automaton.iter(s)]
        strange = [(k, k + 1, tuple(int(self.bytes[b]) for b in c.encode())) for k, c in enumerate(s) if c not in self.chars]
        if strange:
            arcs = sorted(arcs + strange, key=lambda a: a[1])
        return len(s), arcs


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities of each language (pieces x languages)."""

    languages: tuple[str, ...]
    probability: np.ndarray


def _forward(n: int, arcs: list, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Scaled forward sums at each position, the log of their scale, and each arc's probability."""
    alpha = np.zeros((n + 1, probability.shape[1]))
    alpha[0] = 1
    log, here, weights = np.zeros(n + 1), 0, []
    for a, b, ids in arcs:
        w = probability[ids[0]] if len(ids) == 1 else probability[list(ids)].prod(0)
        weights.append(w)
        if b != here:
            # positions get the scale of the one before; rescaled when sums get small
            for k in range(here + 1, b + 1):
                log[k] = log[k - 1]
            if 0 < (m := alpha[here].max()) < 1e-60:
                log[here + 1 : b + 1] += np.log(m)
            here = b
        shift = log[a] - log[b]
        alpha[b] += alpha[a] * w * (np.exp(shift) if shift else 1.0)
    return alpha, log, weights


def score_unit(pieces: Pieces, model: LanguageModel, unit: str) -> np.ndarray:
    """Log probability of a unit in each language, summed over all its segmentations."""
    n, arcs = pieces.lattice(unit)
    alpha, log, _ = _forward(n, arcs, model.probability)
    return np.log(np.maximum(alpha[n], 1e-300)) + log[n]


def fit(pieces: Pieces, counts: dict[str, Counter], rounds: int = 3, prior: float = 300.0) -> LanguageModel:
    """Piece probabilities by expectation maximisation over all segmentations of the counted units.

    Each language is smoothed by `prior` pieces of the pooled distribution, so that a unit
    seen in none of them favours none.
    """
    langs = tuple(sorted(counts))
    words = sorted(set().union(*counts.values()))
    weight = np.array([[counts[x][w] for x in langs] for w in words], float)
    lattices = [pieces.lattice(w) for w in words]
    p = np.full((pieces.size, len(langs)), 1e-4)
    for _ in range(rounds):
        expected = np.zeros((pieces.size, len(langs)))
        for (n, arcs), c in zip(lattices, weight, strict=True):
            alpha, log, ws = _forward(n, arcs, p)
            total = np.maximum(alpha[n], 1e-300)
            beta = np.zeros_like(alpha)
            beta[n] = c / total
            for (a, b, ids), w in zip(reversed(arcs), reversed(ws), strict=True):
                shift = log[a] - log[b]
                flow = beta[b] * w * (np.exp(shift) if shift else 1.0)
                for i in ids:
                    expected[i] += alpha[a] * flow
                beta[a] += flow
        pool = expected.sum(1)
        pool = (pool + 1e-3) / (pool + 1e-3).sum()
        p = (expected + prior * pool[:, None]) / (expected.sum(0) + prior)
    return LanguageModel(langs, p)


def train(docs: list[tuple[str, str]], folder: str = TOKENIZERS) -> LanguageModel:
    """A model from (text, language) documents whose labels are mostly right.

    A first model is fitted on the labels; every paragraph then counts for the language
    that model gives it if it is sure, and for none otherwise; the second fit is the result.
    """
    pieces = Pieces(folder)
    paras = [(units(p), lang) for t, lang in docs for p in paragraphs(t)]
    counts: dict[str, Counter] = {}
    for us, lang in paras:
        counts.setdefault(lang, Counter()).update(u.lower() for u in us)
    if not counts:
        raise ValueError("no labelled text to learn languages from")
    first = Scorer(pieces, fit(pieces, counts))
    again: dict[str, Counter] = {lang: Counter() for lang in counts}
    for us, _ in paras:
        lang, sure = first.judge(us)
        if lang and sure > 0.99:
            again[lang].update(u.lower() for u in us)
    return fit(pieces, {k: v or counts[k] for k, v in again.items()})


class Scorer:
    """Scores lists of units, keeping those already scored."""

    def __init__(self, pieces: Pieces, model: LanguageModel):
        self.pieces, self.model = pieces, model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)))

    def _row(self, unit: str) -> int:
        i = len(self.known)
        if i == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[i] = score_unit(self.pieces, self.model, unit.lower())
        self.known[unit] = i
        return i

    def judge(self, us: Sequence[str]) -> tuple[str | None, float]:
        """The most probable language and its posterior (equal priors); None for no units."""
        if not us:
            return None, 0.0
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        rows = [self._row(u) if (i := known.get(u)) is None else i for u in us]
        total = self.scores[rows].sum(0)
        post = np.exp(total - total.max())
        best = int(post.argmax())
        return self.model.languages[best], float(post[best] / post.sum())


def training_sample(df: DataFrame, ident: str, text: str, label: str, per_label: int, longest: int) -> list[tuple[str, str]]:
    """At most `per_label` documents per language with a usable label, of at most `longest` characters.

    The choice is by hash of the text, so it doesn't depend on order or partitions; of equal texts one is taken. The ids
    are chosen by bounded heaps (per_label entries per language and map task); only their
    documents, a bounded number of bounded texts, come to the driver.
    """
    norm = F.lower(F.trim(F.col(label)))
    code = F.element_at(F.split(norm, "[-_]"), 1)
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    code = F.coalesce(known[code], code)
    usable = df.where(F.col(text).isNotNull() & (F.length(text) <= longest) & (F.length(F.trim(text)) > 0)).withColumn("_lang", code).where(F.col("_lang").isin(*LANGUAGES))
    # equal texts count once, so that copies of one text can't fill a language's places
    once = usable.groupBy("_lang", F.xxhash64(text).alias("h")).agg(F.min(ident).alias("id"))
    heap = InternalFunction.collect_top_k(F.struct("h", "id"), per_label, True)
    ids = once.groupBy("_lang").agg(heap.alias("_top")).select("_lang", F.explode("_top.id").alias(ident))
    # at most len(LANGUAGES) * per_label rows
    chosen = usable.join(F.broadcast(ids), [ident, "_lang"], "left_semi").select(text, "_lang")
    return sorted((r[0], r[1]) for r in chosen.collect())


def assign_languages(df: DataFrame, ident: str, text: str, label: str, per_label: int = 300, longest: int = 20_000, least: float = 0.6, folder: str = TOKENIZERS) -> DataFrame:
    """Language and confidence of each document (seg_no 0) and each of its paragraphs (1, 2, ...).

    Columns: ident, seg_no, lang, confidence, chars, label_lang (what the label names or
    null), n_langs (languages in the document). A paragraph without words has a null lang, and so
    has, unless the document holds two other languages for sure, one of which no language is
    at least `least` probable (names alone); the document's
    language is the one with most characters, null if there is none, and its confidence
    the characters' mean of that language's paragraphs times their share. Null, empty and
    wordless texts give one row with null lang. The model is fitted on a bounded sample of
    labelled rows (per_label, longest); whole texts of all rows are scored in one map.
    """
    model = train(training_sample(df, ident, text, label, per_label, longest), folder)
    sent = df.sparkSession.sparkContext.broadcast(model)  # pieces x languages doubles, 2 MB whatever the corpus
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Pieces(folder), sent.value)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i, t, lab in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = []
                for p in paragraphs(t):
                    lang, sure = scorer.judge(units(p))
                    found.append((lang, sure, len(p)))
                # beside two sure languages an unsure paragraph has words of its most probable one; otherwise it is of none
                mixed = len({lang for lang, sure, _ in found if lang and sure >= least}) > 1
                found = [(lang if mixed or sure >= least else None, sure, n) for lang, sure, n in found]
                chars: dict[str, float] = {}
                sums: dict[str, float] = {}
                for lang, sure, n in found:
                    if lang:
                        chars[lang] = chars.get(lang, 0) + n
                        sums[lang] = sums.get(lang, 0.0) + n * sure
                main = min(chars, key=lambda x: (-chars[x], x)) if chars else None
                conf = sums[main] / sum(chars.values()) if main else 0.0
                for seg, (lang, sure, n) in enumerate([(main, conf, len(t or "")), *found]):
                    for c, v in zip(cols, (i, seg, lang, sure, n, label_language(lab), len(chars)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_pydict(dict(zip((ident, "seg_no", "lang", "confidence", "chars", "label_lang", "n_langs"), (pa.array(c, t) for c, t in zip(cols, (b.schema[0].type, pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.int32()), strict=True)), strict=True)))

    return df.select(ident, text, label).mapInArrow(run, f"{ident} {kind}, seg_no int, lang string, confidence double, chars bigint, label_lang string, n_langs int")


def wrong_or_mixed() -> Column:
    """Rows of assign_languages that are a finding: a missing or wrong label, a paragraph of a mixed document."""
    doc = (F.col("seg_no") == 0) & (F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")))
    return F.col("lang").isNotNull() & (doc | ((F.col("seg_no") > 0) & (F.col("n_langs") > 1)))
