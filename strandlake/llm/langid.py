"""Language identification by a linear-chain conditional random field over words.

Every word of a text is a position of the chain; a word of more than 24 bytes is several, one a piece. Its potentials
come from hashed affixes and character n-grams and from lexicons learned for each language; transitions between languages are learned from sequences that splice runs of words
of different languages. Forward-backward gives each word's label probabilities, so code-switched text is labelled word
by word; a document's language is the one with the largest summed probability.

Only fitting is bounded: at most DOCS_PER_LANGUAGE documents a language (a hash of the id decides which), a run of at
most FIT_BYTES of each. Every document and every whole text is labelled. Defined cases: a null text, or one without a letter, is
`und` with score 0; without any document to learn from every text is `und`; a null id counts as the empty string for the
held-out rule; repeated rows are labelled alike; languages of equal probability go to the first in the order of their
names; a text of any length is labelled whole; an empty table gives an empty result; other columns than id, text and
language are not read, and the kept ones may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import spare_name

DOCS_PER_LANGUAGE = 300
FIT_BYTES = 20_000
LEXICON_WORDS = 5_000
#: Buckets of the hashed features.
BUCKETS = 1 << 16
#: Bytes of a word that features look at, with its two boundary marks.
WIDTH = 26
BLOCK = 32
_TRIM = ".,;:!?\"'()[]{}<>|*#$%&@/\\-_+=~^`«»¿¡…"
#: Bytes of text that a task labels at a time.
SLICE_BYTES = 3 << 20


def word_codes(words: list[bytes]) -> np.ndarray:
    """Matrix of bytes, a row for each word of at most WIDTH - 2 bytes: 2, the word, 3, then zeros."""
    framed = [b"\2" + w + b"\3" for w in words]
    out = np.zeros((len(words), WIDTH), np.uint8)
    flat = np.frombuffer(b"".join(framed), np.uint8)
    n = np.fromiter(map(len, framed), np.int64, len(framed))
    row = np.repeat(np.arange(len(framed)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def feature_ids(codes: np.ndarray) -> np.ndarray:
    """Bucket numbers of each word's features; 0 is no feature. n-grams of 1 to 4 bytes, and affixes of 2 to 4."""
    x = codes.astype(np.uint32)
    cols = []
    for n in (1, 2, 3, 4):
        h = np.full((len(x), WIDTH - n + 1), 2166136261 ^ n, np.uint32)
        live = np.ones(h.shape, bool)
        for k in range(n):
            part = x[:, k : WIDTH - n + 1 + k]
            h = (h ^ part) * np.uint32(16777619)
            live &= part > 0
        h ^= h >> np.uint32(15)
        cols.append(np.where(live, h % np.uint32(BUCKETS - 1) + 1, 0))
    length = (codes > 0).sum(1)
    for n in (3, 4, 5):
        ok = length >= n
        for kind in (7, 8):
            h = np.full(len(x), 2166136261 ^ (n * 16 + kind), np.uint32)
            for k in range(n):
                at = np.full(len(x), k) if kind == 7 else np.maximum(length - n + k, 0)
                h = (h ^ x[np.arange(len(x)), at]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            cols.append(np.where(ok, h % np.uint32(BUCKETS - 1) + 1, 0)[:, None])
    return np.concatenate(cols, axis=1).astype(np.int32)


class Crf:
    """Weights of a linear-chain field: by feature bucket and by lexicon, and transitions; labels in order."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.w = np.zeros((BUCKETS, k), np.float32)
        self.lex_w = np.zeros((k, k), np.float32)
        self.trans = np.zeros((k, k))
        # Of each word: a byte for each label, 1 where the word is in the label's lexicon.
        self.lexicon: dict[bytes, bytes] = {}

    def known(self, words: list[bytes]) -> np.ndarray:
        """Membership of each word in each label's lexicon, 0 or 1."""
        k = len(self.labels)
        return np.frombuffer(b"".join(map(self.lexicon.get, words, [bytes(k)] * len(words))), np.uint8).reshape(len(words), k).astype(np.float32)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Log potentials of each word, by label."""
        out = np.empty((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            ids = feature_ids(word_codes(some))
            e = self.w[ids].sum(1)
            out[i : i + 8192] = e + self.known(some) @ self.lex_w
        return out


def marginals(potential: np.ndarray, live: np.ndarray, trans: np.ndarray, first: np.ndarray, doc: np.ndarray):
    """Label probabilities by forward-backward.

    potential: (blocks, BLOCK, k) positive; live: which positions are words; first: first block of each document, in
    order, doc: each block's document. Blocks of a document are chained: products of transfer matrices carry the
    messages from block to block, then all blocks run at once.
    """
    n, width, k = potential.shape
    a = np.exp(trans - trans.max())
    eye = np.eye(k)
    opens = np.zeros(n, bool)
    opens[first] = True
    step = np.broadcast_to(eye, (n, k, k)).copy()
    for t in range(width):
        # A document's first word follows nothing: every label is as likely before it.
        move = step @ a if t else np.where(opens[:, None, None], step, step @ a)
        nxt = move * potential[:, t, None, :]
        nxt /= nxt.max(axis=(1, 2), keepdims=True)
        step = np.where(live[:, t, None, None], nxt, step)
    counts = np.diff(np.append(first, n))
    into, out = np.full((n, k), 1 / k), np.ones((n, k))
    for j in range(1, int(counts.max(initial=1))):
        b = first[counts > j] + j
        m = (into[b - 1][:, None, :] @ step[b - 1])[:, 0]
        into[b] = m / m.sum(1, keepdims=True)
        back = (first + counts - 1)[counts > j] - j
        m = (step[back + 1] @ out[back + 1][:, :, None])[:, :, 0]
        out[back] = m / m.sum(1, keepdims=True)
    alpha = np.empty_like(potential)
    m = into
    for t in range(width):
        nxt = (m @ a if t else np.where(opens[:, None], m, m @ a)) * potential[:, t]
        nxt /= nxt.sum(1, keepdims=True)
        m = np.where(live[:, t, None], nxt, m)
        alpha[:, t] = m
    beta = out
    post = np.empty_like(potential)
    for t in range(width - 1, -1, -1):
        p = alpha[:, t] * beta
        post[:, t] = p / p.sum(1, keepdims=True)
        prev = (beta * potential[:, t]) @ a.T
        beta = np.where(live[:, t, None], prev / prev.sum(1, keepdims=True), beta)
    return post


def word_pieces(word: bytes) -> list[bytes]:
    """The word, or consecutive parts of at most WIDTH - 2 bytes, cut between characters."""
    out, at = [], 0
    while len(word) - at > WIDTH - 2:
        end = at + WIDTH - 2
        while word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document of each word, its entry in the vocabulary, vocabulary): lower-cased, trimmed words with a letter, long ones in pieces."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.utf8_trim(lists.flatten(), characters=_TRIM).dictionary_encode()
    codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    lettered = pc.match_substring_regex(vocabulary, r"\pL").to_numpy(zero_copy_only=False).astype(bool)
    number = np.cumsum(lettered) - 1
    keep = lettered[codes] if len(codes) else np.zeros(0, bool)
    doc, code, words = doc[keep], number[codes[keep]], [w.encode() for w in vocabulary.filter(pa.array(lettered)).to_pylist()]
    if max(map(len, words), default=0) <= WIDTH - 2:
        return doc, code, words
    entry: dict[bytes, int] = {}
    parts = [[entry.setdefault(x, len(entry)) for x in word_pieces(w) if len(w) <= WIDTH - 2 or any(map(str.isalpha, x.decode()))] for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n, flat = sizes[code], np.array([x for some in parts for x in some], np.int64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(doc, n), flat[np.repeat((np.cumsum(sizes) - sizes)[code], n) + within], list(entry)


def chain_blocks(doc: np.ndarray):
    """Lay the words of documents (doc ascending) into blocks: (block, place) of each word, first blocks, block's doc."""
    ids, start, n = np.unique(doc, return_index=True, return_counts=True)
    per = -(-n // BLOCK)
    first = np.cumsum(per) - per
    at = np.arange(len(doc)) - np.repeat(start, n)
    return np.repeat(first, n) + at // BLOCK, at % BLOCK, first, np.repeat(ids, per)


def label_words(model: Crf, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, label probabilities of each word)."""
    doc, code, vocabulary = split_words(texts)
    k = len(model.labels)
    if not len(doc):
        return doc, np.zeros((0, k))
    e = model.emissions(vocabulary).astype(np.float64)
    e = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
    block, place, first, of = chain_blocks(doc)
    potential = np.ones((len(of), BLOCK, k))
    live = np.zeros((len(of), BLOCK), bool)
    potential[block, place] = e[code]
    live[block, place] = True
    post = marginals(potential, live, model.trans, first, of)
    return doc, post[block, place]


def train(samples: list[tuple[str, str]], seed: int = 3, length: int = 48, sequences: int = 2400, rounds: int = 40) -> Crf:
    """Fit a field to (language, text) pairs by gradient ascent on the conditional likelihood (Adam, full batches).

    Training sequences splice runs of consecutive words of random documents, so changes of language occur in them.
    """
    labels = sorted({lang for lang, _ in samples})
    model, rng, k = Crf(labels), np.random.default_rng(seed), len(labels)
    if k < 2:
        return model
    doc, code, vocabulary = split_words([text for _, text in samples])
    lang = np.array([labels.index(x) for x, _ in samples])
    seen = np.zeros((len(vocabulary), k))
    np.add.at(seen, (code, lang[doc]), 1)
    for j in range(k):
        share = seen[:, j] / np.maximum(seen.sum(1), 1)
        good = np.nonzero((seen[:, j] >= 3) & (share > 0.2))[0]
        for v in good[np.argsort(-seen[good, j], kind="stable")][:LEXICON_WORDS]:
            held = model.lexicon.get(vocabulary[v], bytes(k))
            model.lexicon[vocabulary[v]] = held[:j] + b"\1" + held[j + 1 :]
    start, n = np.unique(doc, return_index=True, return_counts=True)[1:]
    ids = np.unique(doc)
    by_lang = [np.nonzero(lang[ids] == j)[0] for j in range(k)]
    by_lang = [x for x in by_lang if len(x)]
    x, y = np.zeros((sequences, length), np.int64), np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            d = rng.choice(by_lang[rng.integers(len(by_lang))])
            run = min(length - at, 1 + int(rng.geometric(1 / 24)), int(n[d]))
            b = start[d] + int(rng.integers(n[d] - run + 1))
            x[s, at : at + run], y[s, at : at + run] = code[b : b + run], lang[ids[d]]
            at += run
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(sequences, length)
    words = [vocabulary[v] for v in used]
    feats = feature_ids(word_codes(words))
    known = model.known(words)
    # Words that are in the lexicon only because they were seen here tell nothing: hide it from half of them.
    known[rng.random(len(known)) < 0.5] = 0
    buckets, inner = np.unique(feats, return_inverse=True)
    inner = inner.reshape(feats.shape)
    w = np.zeros((len(buckets), k))
    params = {"w": w, "lex": np.zeros((len(model.lex_w), k)), "t": np.zeros((k, k))}
    first_m = {p: np.zeros_like(v) for p, v in params.items()}
    second_m = {p: np.zeros_like(v) for p, v in params.items()}
    gold = np.zeros((sequences, length, k))
    np.put_along_axis(gold, y[:, :, None], 1, axis=2)
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    flat = inner.ravel()
    for r in range(1, rounds + 1):
        e = np.zeros((len(words), k))
        for c in range(0, len(words), 4096):
            e[c : c + 4096] = params["w"][inner[c : c + 4096]].sum(1)
        e += known @ params["lex"]
        e = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))[x]
        a = np.exp(params["t"] - params["t"].max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        m = np.full((sequences, k), 1 / k)
        for t in range(length):
            m = (m @ a if t else m) * e[:, t]
            m /= m.sum(1, keepdims=True)
            alpha[:, t] = m
        for t in range(length - 2, -1, -1):
            b = (beta[:, t + 1] * e[:, t + 1]) @ a.T
            beta[:, t] = b / b.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * a * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        diff = (gold - post).reshape(-1, k)
        by_word = np.stack([np.bincount(x.ravel(), diff[:, j], len(words)) for j in range(k)], axis=1)
        wide = np.repeat(by_word, feats.shape[1], axis=0)
        grad = {
            "w": np.stack([np.bincount(flat, wide[:, j], len(buckets)) for j in range(k)], axis=1) - 0.1 * params["w"],
            "lex": known.T @ by_word - 0.1 * params["lex"],
            "t": gold_t - pair.sum((0, 1)) - 0.1 * params["t"],
        }
        grad["w"][buckets == 0] = 0
        for p, g in grad.items():
            first_m[p] = 0.9 * first_m[p] + 0.1 * g
            second_m[p] = 0.98 * second_m[p] + 0.02 * g * g
            params[p] += 0.05 * (first_m[p] / (1 - 0.9**r)) / (np.sqrt(second_m[p] / (1 - 0.98**r)) + 1e-8)
    model.w[buckets] = params["w"]
    model.lex_w, model.trans = params["lex"].astype(np.float32), params["t"]
    return model


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 3, is 1; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Crf | None:
    """Learn from documents that are not held out and whose language is known; None if there are none."""
    docs = docs.select(id_col, text_col, lang_col)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = known.groupBy(lang_col).count().collect()
    if not counts:
        return None
    # A hash threshold for each language thins the rows before any sort, to about twice what is wanted.
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col(lang_col) == r[0], int((1 << 30) * min(1.0, 2 * per_language / r[1]))).otherwise(share)
    draw = F.xxhash64(id_col, F.lit("languages"))
    some = known.withColumn("__draw", draw).filter(F.pmod("__draw", F.lit(1 << 30)) <= share)
    # A long document gives a run of whole words from a place that its hash chooses; a character has four bytes at most.
    chars = FIT_BYTES // 4
    start = F.pmod(F.xxhash64("__draw"), F.length(text_col) - chars + 1).cast("int") + 1
    run = F.substring(F.col(text_col), F.when(F.length(text_col) > chars, start).otherwise(1), F.lit(chars))
    run = F.when(run.rlike(r"\s\S+\s"), F.regexp_replace(run, r"^\S+\s+|\s+\S+$", "")).otherwise(run)
    some = some.withColumn(text_col, F.when(F.octet_length(text_col) > FIT_BYTES, run).otherwise(F.col(text_col)))
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy("__draw", id_col, text_col))
    rows = some.select(lang_col, id_col, text_col, "__draw").withColumn("__n", place).filter(F.col("__n") <= per_language).orderBy(lang_col, "__n")
    return train([(r[0], r[1]) for r in rows.select(lang_col, text_col).collect()])


def _label(model: Crf):
    def run(batches):
        k = len(model.labels)
        names = np.array([*model.labels, "und"], object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.diff(np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
            part = np.cumsum(sizes) // SLICE_BYTES
            lang, score = np.full(batch.num_rows, k), np.zeros(batch.num_rows)
            for p in np.unique(part):
                at = np.nonzero(part == p)[0]
                some = [x or "" for x in texts.slice(at[0], len(at)).to_pylist()]
                doc, post = label_words(model, some)
                mass = np.stack([np.bincount(doc, post[:, j], len(at)) for j in range(k)], axis=1)
                total = mass.sum(1)
                lang[at] = np.where(total > 0, mass.argmax(1), k)
                score[at] = np.where(total > 0, mass.max(1) / np.maximum(total, 1e-9), 0)
            out = [pa.array(names[lang].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, model: Crf | None, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The `keep` columns of each row, plus lang_pred string and score double."""
    rows = docs.select(*keep, F.col(text_col).alias(spare_name(docs, "__text")))
    if model is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_label(model), schema)


def language_ids(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = predict_languages(docs, fit_languages(docs, per_language=per_language))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
