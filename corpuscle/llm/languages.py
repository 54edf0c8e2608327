"""Missing or wrong document language labels: a language with a confidence for each document and each segment.

A text is cut into sentences; code, identifiers, commands and quoted output are taken out first. Each sentence is the
average of the embeddings of its hashed character n-grams, followed by a linear softmax. Embeddings and softmax are
trained in numpy by stochastic gradient descent on a bounded sample of labelled documents: labels may be wrong, so
each half first judges the labels of the other and refused sentences are left out; the model is trained on the rest, and
on copies without accents. A temperature and a threshold are then set on held-out sentences, below which a sentence is rejected. Letters that a language does not have rule it out.

Cases: null, empty and blank texts, and texts without a sentence of five words (ten characters in Chinese or Japanese)
have no language. Labels are read as a code of two or three letters with or without region, or as an English name, in
any case; anything else names no language. Texts are read whole. Repeated texts are judged each. If no document is
labelled with a known language, nothing can be trained and no text has a language.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import path_exists
from ..session import shared_base, spread

# fixed values: ISO 639-1 code, ISO 639-2 and -3 codes, English names
NAMES = """
ar ara arabic|bg bul bulgarian|ca cat catalan|cs ces cze czech|da dan danish|de deu ger german|el ell gre greek|en eng english
|es spa spanish castilian|et est estonian|fa fas per persian farsi|fi fin finnish|fr fra fre french|he heb iw hebrew|hi hin hindi
|hr hrv croatian|hu hun hungarian|id ind in indonesian|it ita italian|ja jpn japanese|ko kor korean|lt lit lithuanian|lv lav latvian
|nl nld dut dutch flemish|no nor nb nob nn nno norwegian|pl pol polish|pt por portuguese|ro ron rum romanian|ru rus russian
|sk slk slo slovak|sl slv slovenian slovene|sr srp serbian|sv swe swedish|th tha thai|tr tur turkish|uk ukr ukrainian
|vi vie vietnamese|zh zho chi cmn chinese mandarin
"""
CODES = {w: e.split()[0] for e in NAMES.replace("\n", "").split("|") for w in e.split()}

VERSION = 1  # of the training, to be raised with it
STORED = "langs array<string>, scores binary, bias binary, temperature double, threshold double"
BUCKETS, DIM, RATE, EPOCHS = 1 << 16, 16, 40.0, 5  # buckets of 16 bits
GRAMS = (1, 2, 3)


@functools.lru_cache(100_000)
def label_code(label: str | None) -> str | None:
    """Two-letter code of a label, None if it names no language."""
    s = (label or "").strip().lower()
    if s in CODES:
        return CODES[s]
    m = re.fullmatch(r"([a-z]{2,3})[-_](?:[a-z]{4}[-_])?(?:[a-z]{2}|\d{3}|[a-z]{4})(?:[.@].*)?", s)
    if m and m[1] in CODES:
        return CODES[m[1]]
    m = re.fullmatch(r"([a-z]+)\s*\(.*\)", s)
    return CODES.get(m[1]) if m else None


# -- sentences

_FENCE = re.compile(r"(?ms)^[ \t>]*(```|~~~)[^\n]*\n.*?(?:^[ \t>]*\1[^\n]*$|\Z)")
_DROP = re.compile(
    r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|\[[^\]\n]{1,20}\][ \t]*[^.。\n]*(?=[.。\n]|$)|https?://\S+|[\w.+-]+@[\w.-]+|\S*[/\\]\S+\.\w+\S*|\b\w+(?:_\w+)+\b(?:\([^)\n]*\))?|\b\w+\([^)\n]*\)|#\d+|<[^<>\n]*>|[A-Za-z0-9+/=_-]{32,}|\b[a-z]+(?:[A-Z][a-z]+)+\b|--?[a-z][\w-]+(?==|\b)(?<=--\w)"
)
_CODE = re.compile(
    r"^(?:\t| {4,})?\s*(?:(?:let|const|var|import|from|return|func|function|def|class|fn|pub|use|package|public|private|if|for|while|else|export|print|log|throw|try|catch|switch|case|new|async|await)\b.*[=({;:\])}]|[\w.\[\]]+\s*(?:[:+\-*/]?=)\s*.+|[\w.]+\(.*\)[;,]?|[{}()\[\];,]+|[$>%#]\s+(?:git|npm|pip|cargo|go|python|cd|ls|curl|make|docker|sudo|java|node|rm|cp|mv|cat|grep)\b.*|"
    r"at \S+\(.*|Traceback.*|File \".*|\w*(?:Error|Exception|Warning):.*|(?:\[?\d{4}-\d\d-\d\d[T ]?[\d:.,Z]*\]?|\d\d:\d\d:\d\d[.,\d]*)\s.*|(?:FATAL|ERROR|WARN|WARNING|INFO|DEBUG|TRACE|fatal|error|warning|panic)\b\s*[:\[(].*|[-+]{3} .*|@@ .*|diff --git.*|\|.*\|)\s*$"
)
_MARGIN = re.compile(r"^[\s>*#/+\-–•|!;%]*(?:\d+[.)]\s+)?")
_SPEAKER = re.compile(r"^(?:[A-Z]|\w{1,10}):\s")
_END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_SYMBOL = re.compile(r"[{}=;<>_\\|&$@^~\[\]]")


_MARKS = re.compile(r"[`\"“«„\[/\\@_#<(]")
_CAMEL = re.compile(r"[a-z][A-Z]")


def _may_drop(part: str) -> bool:
    """False only if nothing in the text is taken out by _DROP: no mark, no option, no camel case, no word of 32 characters."""
    return _MARKS.search(part) is not None or "--" in part or _CAMEL.search(part) is not None or any(len(w) > 31 for w in part.split())


_DIGIT = re.compile(r"\d")
_ODD = re.compile(r"(?<!\S)(?:\S{1,2}(?!\S)|[^\s\d]*\d\S*)")


def _dump(text: str) -> bool:
    """Hexadecimal and other dumps: half of the tokens hold a digit or are shorter than three letters."""
    return _DIGIT.search(text) is not None and len(_ODD.findall(text)) > 0.5 * len(text.split())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, cleaned text) of every whole sentence that is long enough to count."""
    if not text or not text.strip():
        return []
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out, at = [], 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        if not line.strip() or _CODE.match(line):
            continue
        lead = _MARGIN.match(line)
        body = line[lead.end() :]
        speaker = _SPEAKER.match(body)
        pos = lead.end() + (speaker.end() if speaker else 0)
        for part in _END.split(line[pos:]):
            if not part:
                continue
            start = begin + line.find(part, pos)
            pos = start - begin + len(part)
            bare = _DROP.sub(" ", part) if _may_drop(part) else part
            cjk = 0 if bare.isascii() else len(_CJK.findall(bare))
            n = len(_WORD.findall(bare))
            if cjk * 2 >= len(bare.strip()) and cjk:
                if cjk < 10:
                    continue
            elif n < 5 or _dump(bare) or len(_SYMBOL.findall(bare)) > 0.05 * len(bare):
                continue
            out.append((start, start + len(part), bare))
    return out


# -- features: hashed character n-grams of many sentences at once


_NO_LETTER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    """Lower case, all that is no letter as one blank, and an apostrophe kept."""
    return _NO_LETTER.sub(" ", " " + text.lower() + " ")


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: bucket of every n-gram of all texts, and where those of each text begin."""
    parts = [_letters(t) for t in texts]
    lens = np.array([len(p) for p in parts], np.int64)
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lens)])
    owner = np.repeat(np.arange(len(parts)), lens)
    left = first[1:][owner] - np.arange(len(cp))  # characters to the end of the text
    h = np.zeros(len(cp), np.uint64)
    out = []
    for n in GRAMS:
        part = np.zeros(len(cp), np.uint64)
        part[: max(0, len(cp) - n + 1)] = cp[n - 1 :]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(n)
        ok = left >= n
        if n == 1:
            ok &= cp != 32
        g = h[ok]
        g ^= g >> np.uint64(29)
        g = g * np.uint64(0xBF58476D1CE4E5B9)
        out.append(((g >> np.uint64(48)).astype(np.int64), np.searchsorted(owner[ok], np.arange(len(parts) + 1))))
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every n, text by text, and where those of each text begin."""
    per = grams(texts)
    b = np.concatenate([x for x, _ in per])
    o = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(f)) for _, f in per])
    order = np.argsort(o, kind="stable")
    return b[order], np.searchsorted(o[order], np.arange(len(texts) + 1))


# fixed values: scripts by code points, and letters that Russian or Ukrainian lacks
_SCRIPT = re.compile(r"(?P<kana>[\u3041-\u30ff])|(?P<han>[\u3400-\u9fff])|(?P<cyrillic>[\u0400-\u04ff]{3})|(?P<hangul>[\uac00-\ud7af])|(?P<greek>[\u0370-\u03ff]{3})|(?P<arabic>[\u0600-\u06ff])")
_KANA = re.compile(r"[\u3041-\u30ff]")
_NOT_RU = re.compile(r"[\u0456\u0457\u0454\u0491\u0406\u0407\u0404\u0490]")
_NOT_UK = re.compile(r"[\u044b\u044d\u044a\u0451\u042b\u042d\u042a\u0401]")
RULED_OUT = {"kana": ["zh"], "han": [], "cyrillic": [], "hangul": [], "greek": [], "arabic": []}


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def _possible(self, texts: list[str]) -> np.ndarray:
        """0 where the letters of a text rule a language out."""
        ok = np.ones((len(texts), len(self.langs)), np.float32)
        col = {c: i for i, c in enumerate(self.langs)}
        for i, t in enumerate(texts):
            if t.isascii() or not (m := _SCRIPT.search(t)):
                continue
            for c in RULED_OUT[m.lastgroup]:
                if c in col:
                    ok[i, col[c]] = 0
            if m.lastgroup == "han":
                c = "zh" if _KANA.search(t) else "ja"
                if c in col:
                    ok[i, col[c]] = 0
            elif m.lastgroup == "cyrillic":
                for letters, c in ((_NOT_RU, "ru"), (_NOT_UK, "uk")):
                    if c in col and letters.search(t):
                        ok[i, col[c]] = 0
        return ok

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return self.softmax(self.logits(texts), self._possible(texts))

    def softmax(self, logits: np.ndarray, possible: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z -= z.max(1, keepdims=True, initial=-np.inf)
        e = np.exp(z) * possible
        return e / np.maximum(e.sum(1, keepdims=True), 1e-30)

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < 60_000):
                size += len(texts[end])
                end += 1
            sums = np.zeros((end - at, len(self.langs)), np.float32)
            n = np.zeros(end - at, np.int64)
            for b, first in grams(texts[at:end]):
                k = np.diff(first)
                full = k > 0  # reduceat has no empty segments
                if full.any():
                    sums[full] += np.add.reduceat(self.scores[b], first[:-1][full], axis=0)
                n += k
            out[at:end] = sums / np.maximum(1, n)[:, None] + self.bias
            at = end
        return out


def _sgd(feats, y: np.ndarray, classes: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias by mini-batch gradient descent with decaying rate."""
    rng = np.random.default_rng(seed)
    b, first = feats
    emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)  # n-grams never seen stay near nothing
    w = rng.normal(0, 1.0, (DIM, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    n, size = len(y), 128
    steps, step = epochs * -(-n // size), 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), -(-n // size)):
            lens = first[batch + 1] - first[batch]
            share = (1 / lens).astype(np.float32)[:, None]
            idx = np.concatenate([b[first[i] : first[i + 1]] for i in batch])
            at = np.concatenate([[0], np.cumsum(lens)[:-1]])
            x = np.add.reduceat(emb[idx], at, axis=0) * share
            z = x @ w + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            lr = rate * (1 - step / steps)
            gx = (p @ w.T) * share
            w -= lr * 0.05 / len(batch) * (x.T @ p)
            bias -= lr * 0.05 / len(batch) * p.sum(0)
            order = np.argsort(idx.astype(np.uint16), kind="stable")  # of 16 bits, so it is a radix sort
            owner = np.repeat(np.arange(len(batch)), lens)[order]
            s = idx[order]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            often = np.diff(np.concatenate([cuts, [len(s)]]))
            emb[s[cuts]] -= lr * np.add.reduceat(gx[owner], cuts, axis=0) / np.sqrt(often.astype(np.float32))[:, None]
            step += 1
    return emb, w, bias


def _balanced(y: np.ndarray, least: int = 500) -> np.ndarray:
    """Indices that repeat the examples of rare classes, so that none is drowned by the frequent ones."""
    out = []
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        out.append(np.tile(at, max(1, -(-min(least, len(y) // 4) // len(at)))))
    return np.concatenate(out)


def _fit(texts: list[str], y: np.ndarray, langs: list[str], seed: int, share: float = 1.0) -> Model:
    """A model of enough steps for the number of examples."""
    at = _balanced(y)
    b, first = features(texts)
    spans = [b[first[i] : first[i + 1]] for i in at]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in spans])])
    epochs = max(2, round(share * max(EPOCHS, min(20, 50_000 / len(at)))))
    emb, w, bias = _sgd((np.concatenate(spans), ends), y[at], len(langs), epochs, RATE, seed)
    return Model(langs, (emb @ w).astype(np.float32), bias)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """From (sentence, code) pairs, some of which are wrong."""
    rows = [(t, c) for t, c in rows if _letters(t).strip()]
    langs = sorted({c for _, c in rows})
    if len(langs) < 2:
        return Model(langs, np.zeros((BUCKETS, max(1, len(langs))), np.float32), np.zeros(max(1, len(langs)), np.float32))
    code = {c: i for i, c in enumerate(langs)}
    texts = [t for t, _ in rows]
    y = np.array([code[c] for _, c in rows])
    # each half judges the labels of the other, so that no model can have learnt a wrong label by heart
    half = np.random.default_rng(seed).random(len(rows)) < 0.5
    good = np.ones(len(rows), bool)
    for side in (half, ~half):
        if len(set(y[side])) == len(langs):
            m = _fit([t for t, h in zip(texts, side) if h], y[side], langs, seed, 0.6)
            p = m.probabilities([t for t, h in zip(texts, side) if not h])
            own = p[np.arange(len(p)), y[~side]]
            right = p.argmax(1) == y[~side]
            for c in range(len(langs)):  # a language that the judge does not know yet is judged leniently
                at = y[~side] == c
                if at.any() and right[at].mean() < 0.4:
                    right |= at & (p.max(1) < 4 * own)
            good[~side] = right
    texts, y = [t for t, g in zip(texts, good) if g], y[good]
    held = np.random.default_rng(seed).random(len(texts)) < 0.15
    fit = [t for t, h in zip(texts, held) if not h]
    plain = [i for i, t in enumerate(fit) if not t.isascii()]
    yf = y[~held]
    model = _fit(fit + [unaccented(fit[i]) for i in plain], np.concatenate([yf, yf[plain]]) if plain else yf, langs, seed + 1)
    return _calibrated(model, [t for t, h in zip(texts, held) if h] or fit, y[held] if held.any() else yf)


def _calibrated(model: Model, texts: list[str], y: np.ndarray, precision: float = 0.995) -> Model:
    """Temperature by held-out likelihood; the threshold is the least that gives the precision, within 0.5 and 0.98."""
    best, logits, possible = None, model.logits(texts), model._possible(texts)
    for t in (0.1, 0.15, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        model.temperature = t
        p = model.softmax(logits, possible)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).mean()
        if best is None or loss < best[0]:
            best = (loss, t)
    model.temperature = best[1]
    p = model.softmax(logits, possible)
    conf, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-conf)
    rate = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(rate >= precision)
    model.threshold = float(min(0.98, max(0.5, conf[order][ok[-1]] if len(ok) else 0.98)))
    return model


def sample_sentences(documents: DataFrame, per_language: int = 120, most_chars: int = 4000) -> list[tuple[str, str]]:
    """Sentences of a bounded sample: about ``per_language`` documents of each labelled language, by hash of their id.

    The counts by label cover all documents and all spellings; only the sample's texts, and of those ``most_chars``
    characters, leave the executors. It is at most a few thousand documents however many there are.
    """

    @F.pandas_udf("string")
    def code_of(labels: pd.Series) -> pd.Series:
        return labels.map(label_code)

    spelt = documents.groupBy("lang").agg(F.count("*").alias("n"))
    total = {r["code"]: r["n"] for r in spelt.groupBy(code_of("lang").alias("code")).agg(F.sum("n").alias("n")).where("code IS NOT NULL").collect()}  # one row a language
    if not total:
        return []
    share, scale = F.lit(0), 1 << 20
    for code in sorted(total):
        share = F.when(F.col("_code") == code, F.lit(int(scale * min(1.0, per_language / total[code])))).otherwise(share)
    picked = documents.where("text IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(scale)).alias("_h"), code_of("lang").alias("_code")).where(F.col("_h") < share)
    rows = picked.select("lang", F.substring("text", 1, most_chars).alias("text"), "_h").orderBy("_h", "lang", "text").limit(per_language * 3 * len(total)).collect()
    return [(s, code) for r in rows if (code := label_code(r["lang"])) for _, _, s in sentences(r["text"])[:12]]


def fit(documents: DataFrame, per_language: int = 120) -> Model:
    """The model of a corpus. It is a function of its sample alone, so it is stored in the shared folder under the digest
    of that and trained once, however many queries, sessions and drivers ask for it."""
    rows = sample_sentences(documents, per_language)
    spark = documents.sparkSession
    digest = hashlib.sha1(repr((VERSION, BUCKETS, DIM, RATE, EPOCHS, GRAMS, rows)).encode("utf-8", "surrogatepass")).hexdigest()
    path = f"{shared_base(spark)}/corpuscle-models/language-{digest}"
    stored = spark.read.schema(STORED).parquet(path).collect() if path_exists(spark, f"{path}/_SUCCESS") else []
    if len(stored) == 1:
        r = stored[0]
        scores = np.frombuffer(bytes(r["scores"]), np.float32).reshape(BUCKETS, -1)
        return Model(list(r["langs"]), scores, np.frombuffer(bytes(r["bias"]), np.float32), r["temperature"], r["threshold"])
    m = train(rows)
    row = (m.langs, bytearray(m.scores.tobytes()), bytearray(m.bias.astype(np.float32).tobytes()), float(m.temperature), float(m.threshold))
    spark.createDataFrame([row], STORED).coalesce(1).write.mode("overwrite").parquet(path)
    return m


def segments_of(text: str, model: Model, probabilities: np.ndarray, found: list) -> list[tuple[int, int, str, float, int]]:
    """Runs of sentences of one language: (start, end, code, confidence, sentences). Rejected sentences belong to none."""
    out: list[list] = []
    for (a, b, _), p in zip(found, probabilities):
        k = int(p.argmax())
        c = float(p[k])
        if c < model.threshold:
            continue
        code = model.langs[k]
        if out and out[-1][2] == code:
            out[-1][1] = b
            out[-1][3].append(c)
        else:
            out.append([a, b, code, [c]])
    return [(a, b, code, float(np.mean(cs)), len(cs)) for a, b, code, cs in out]


SEGMENTS = (
    "doc_id bigint, label string, label_code string, n_languages int, seg_no int, start_off int, end_off int, "
    "lang_code string, confidence double, sentences int"
)


def language_segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per segment of each document that has a language. A narrow map: a text is judged whole in one place.

    The model is a few megabytes whatever the corpus, and is sent once to each executor.
    """
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [c.strip().split(" ")[0] for c in SEGMENTS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        for pdf in batches:
            rows = []
            for i in range(0, len(pdf), 200):
                part = pdf.iloc[i : i + 200]
                found = [sentences(t) for t in part["text"]] if len(m.langs) > 1 else [[] for _ in part["text"]]
                p = m.probabilities([s for f in found for _, _, s in f])
                at = 0
                for doc, label, text, f in zip(part["doc_id"], part["lang"], part["text"], found):
                    segs = segments_of(text, m, p[at : at + len(f)], f)
                    at += len(f)
                    n = len({s[2] for s in segs})
                    rows += [(doc, label, label_code(label), n, k, *seg) for k, seg in enumerate(segs)]
            yield pd.DataFrame(rows, columns=names)

    return spread(documents.where(F.col("text").isNotNull()).select("doc_id", "lang", "text")).mapInPandas(run, SEGMENTS)


def document_languages(segments: DataFrame) -> DataFrame:
    """(doc_id, label, lang_code, confidence, n_languages, sentences) for each language of each document."""
    weight = F.col("confidence") * F.col("sentences")
    return segments.groupBy("doc_id", "label", "lang_code").agg(
        F.round(F.sum(weight) / F.sum("sentences"), 6).alias("confidence"), F.max("n_languages").alias("n_languages"), F.sum("sentences").alias("sentences"),
    )


def mislabelled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_code) of the documents whose label is missing or wrong, or that have several languages."""
    segs = language_segments(documents, model)
    wrong = (F.col("n_languages") > 1) | F.col("label_code").isNull() | (F.col("label_code") != F.col("lang_code"))
    return segs.where(wrong).select("doc_id", "lang_code").distinct()
