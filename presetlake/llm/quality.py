"""Quality rules by weak supervision.

Each rule votes good, or votes bad, or abstains. Expectation-maximisation over the counts of the vote patterns of all
documents estimates how often each rule gives each vote on good and on bad documents, and so how accurate it is; the
posterior probability of good quality, and not the passing of all rules, decides.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import ship, store

_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters", "n_marks", "n_plain"]
_SPACE = " \t\n\x0b\x0c\r"
_SPACES, _SYMBOL, _UPPER, _LETTER, _MARK, _ODD, _POINT, _NEW = 1, 2, 4, 8, 16, 32, 64, 255
#: Characters and tokens that are measured at a time; a longer text is cut at white space.
PIECE, TOKENS = 1 << 20, 1 << 15
_kinds = np.full(0x110000, _NEW, np.uint8)


def _kind(c: str) -> int:
    """What a character counts as; odd ones are all but letters, digits, marks and the punctuation of sentences."""
    if c in _SPACE:
        return _SPACES
    word, point = unicodedata.category(c)[0] in "LMN", c in ".,;:!?-'\"()" or unicodedata.category(c)[0] == "P" and ord(c) > 127
    return _SYMBOL * (c in "#*$%&|<>") | _UPPER * c.isupper() | _LETTER * c.isalpha() | _MARK * (c in "!|") | _ODD * (not word and not point) | _POINT * point


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts with their numbers, in groups of about ``PIECE`` characters; longer ones are cut before white space."""
    which, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            which.append(i)
            held.append(text[at:end])
            size, at = size + min(end, len(text)) - at, end
            if size >= PIECE:
                yield which, held
                which, held, size = [], [], 0
    if held:
        yield which, held


def _characters(texts: list[str]) -> np.ndarray:
    """A row for each text: words, their characters, symbols, upper-case letters, letters, marks, plain words.

    A word is plain if it has a letter, no odd character and no two points in a row.
    """
    out = np.zeros((len(texts), 7), np.int64)
    for which, held in _pieces(texts):
        points = np.frombuffer("\n".join(held).encode("utf-32-le") + b"\n\0\0\0", np.uint32)
        kinds = _kinds[points]
        if (new := kinds == _NEW).any():
            for p in np.unique(points[new]).tolist():
                _kinds[p] = _kind(chr(p))
            kinds = _kinds[points]
        kinds[1:] |= (kinds[1:] & kinds[:-1] & _POINT) // (_POINT // _ODD)
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])[:-1]])
        space = (kinds & _SPACES).view(bool)
        sums = lambda bit: np.add.reduceat((kinds & bit) != 0, begins, dtype=np.int64)
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        if not space[0]:
            starts = np.concatenate([[0], starts])
        words = np.bitwise_or.reduceat(kinds, starts) if len(starts) else np.zeros(0, np.uint8)
        owner = np.searchsorted(begins, starts, "right") - 1
        per = lambda mask: np.bincount(owner[mask], minlength=len(held))
        found = [per(np.ones(len(starts), bool)), np.add.reduceat(~space, begins, dtype=np.int64), sums(_SYMBOL), sums(_UPPER), sums(_LETTER), sums(_MARK), per((words & _ODD == 0) & (words & _LETTER != 0))]
        np.add.at(out, which, np.stack(found, 1))
    return out


def repeated(texts: list[list[bytes]]) -> np.ndarray:
    """For each list of words, those in 3-word windows that are found twice or more in it, first ones included."""
    ids: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum())
    out = np.zeros(len(texts), np.int64)
    if total < 4:
        return out
    words = np.fromiter((ids.setdefault(t, len(ids)) for t in chain.from_iterable(texts)), np.int64, total)
    owner = np.repeat(np.arange(len(texts)), lengths)
    # Codes are below the number of words, so products of a code and the number of distinct words fit a long.
    code, _ = pd.factorize(owner * len(ids) + words)
    code, _ = pd.factorize(code[:-1] * len(ids) + words[1:])
    code, _ = pd.factorize(code[:-1] * len(ids) + words[2:])
    whole = owner[2:] == owner[:-2]
    times = np.bincount(code[whole], minlength=int(code.max()) + 1)
    twice = whole & (times[code] > 1)
    covered = np.zeros(total, bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    np.add.at(out, owner, covered)
    return out


def stats(texts: list[str | None]) -> np.ndarray:
    """A row of the fields for each whole text; null counts as empty."""
    whole = [t or "" for t in texts]
    n, chars, symbols, upper, letters, marks, plain = _characters(whole).T
    lines = np.zeros((len(whole), 3), np.int64)
    repeats = np.zeros(len(whole), np.int64)
    held, first, size = [], 0, 0
    for i, text in enumerate(whole):
        seen, count = set(), 0
        for line in text.split("\n"):
            if bare := line.strip(_SPACE):
                count += 1
                lines[i, 1] += bare[-1] in ".!?…"
                seen.add(line)
        lines[i, 0], lines[i, 2] = count, count - len(seen)
        held.append(text.encode().split())  # for bytes, ASCII white space only
        size += len(held[-1])
        if size >= TOKENS or i == len(whole) - 1:
            repeats[first : i + 1] = repeated(held)
            held, first, size = [], i + 1, 0
    return np.stack([n, chars, symbols, lines[:, 2], repeats, lines[:, 0], lines[:, 1], upper, letters, marks, plain], 1)


def measures(docs: DataFrame, text_col: str = "text") -> Column:
    ship(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{x} long" for x in _FIELDS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(stats(list(texts)), columns=_FIELDS, dtype="int64")

    return run(F.col(text_col))


def _rules(m: str) -> dict[str, tuple[Column, Column]]:
    """By name, when a rule votes good and when it votes bad; between the two it abstains.

    The limits are those of published filters (0.1 symbols a word, 3 to 10 characters a word, repeated lines 0.3, at
    least half of the lines ended) or round figures; none is fitted to labels.
    """
    c = lambda x: F.col(f"{m}.{x}").cast("double")
    n, lines, mean = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0)), c("word_chars") / F.greatest(c("n_words"), F.lit(1.0))
    return {
        "length": (c("n_words") >= 100, c("n_words") < 50),
        "mean": (mean.between(3, 7), (mean < 3) | (mean > 10)),
        "symbols": (c("n_symbols") <= 0.01 * n, c("n_symbols") > 0.1 * n),
        "plain": (c("n_plain") >= 0.9 * n, c("n_plain") < 0.7 * n),
        "ended": (c("n_ended") >= 0.8 * lines, c("n_ended") < 0.5 * lines),
        "dup_lines": ((c("n_dup_lines") == 0) & (c("n_lines") > 1), c("n_dup_lines") > 0.3 * lines),
        "repetition": (c("n_repeat_words") <= 0.05 * n, c("n_repeat_words") > 0.2 * n),
        "capitals": (c("n_upper") <= 0.1 * c("n_letters"), c("n_upper") > 0.3 * c("n_letters")),
        "marks": (c("n_marks") <= 0.01 * n, c("n_marks") > 0.1 * n),
    }


RULES = ("length", "mean", "symbols", "plain", "ended", "dup_lines", "repetition", "capitals", "marks")
_VOTES = "01-"


def votes(m: str) -> Column:
    """A string of one character for each rule, from the struct column ``m`` of measures: 0 bad, 1 good, - abstains."""
    rules = _rules(m)
    return F.concat(*(F.when(rules[r][1], "0").when(rules[r][0], "1").otherwise("-") for r in RULES))


@dataclass
class Model:
    """``prior`` of good quality; ``rates[g][r] = (P(bad vote), P(good vote), P(abstains))`` on bad (0) and good (1) text."""

    prior: float
    rates: np.ndarray

    def weights(self) -> np.ndarray:
        """What each vote of each rule adds to the logarithm of the odds of good quality."""
        return np.log(self.rates[1]) - np.log(self.rates[0])

    def odds(self, pattern: str) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(self.weights()[r, _VOTES.index(v)] for r, v in enumerate(pattern))

    def accuracy(self, rule: str) -> float:
        """P(the rule is right | it doesn't abstain)."""
        bad, good = self.rates[:, RULES.index(rule)]
        right, wrong = self.prior * good[1] + (1 - self.prior) * bad[0], self.prior * good[0] + (1 - self.prior) * bad[1]
        return right / (right + wrong)


#: Where the estimate starts, for each rule, on bad and on good text; the share of a class's documents that the start
#: counts as, beside one document.
START, WEAK, PRIOR = ((0.4, 0.3, 0.3), (0.05, 0.8, 0.15)), 0.01, 0.9


def estimate(patterns: dict[str, int], rounds: int = 500) -> Model:
    """Expectation-maximisation from the counts of vote patterns.

    The votes move all rates; a rule only keeps its sense: where it would vote bad more often on good text than on bad,
    or good more often on bad text, the vote gets the same rate on both, and so says nothing.
    """
    n = np.array(list(patterns.values()), float)
    cast = np.array([[[v == x for x in _VOTES] for v in p] for p in patterns], float).reshape(-1, len(RULES), 3)
    start = np.repeat(np.array(START)[:, None], len(RULES), 1)
    model = Model(PRIOR, start)
    for _ in range(rounds if len(n) else 0):
        odds = math.log(model.prior / (1 - model.prior)) + np.einsum("prv,rv->p", cast, model.weights())
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weight = np.stack([n * (1 - good), n * good])
        each = weight.sum(1)
        held = WEAK * each + 1
        rates = (np.einsum("gp,prv->grv", weight, cast) + held[:, None, None] * start) / (each + held)[:, None, None]
        for vote, against in ((0, rates[0, :, 0] < rates[1, :, 0]), (1, rates[0, :, 1] > rates[1, :, 1])):
            rates[:, against, vote] = (each @ rates[:, against, vote]) / each.sum()
        rates[:, :, 2] = np.maximum(1 - rates[:, :, 0] - rates[:, :, 1], 1e-9)
        moved = float(np.abs(rates - model.rates).max())
        model = Model(float((each[1] + PRIOR) / (each.sum() + 1)), rates)
        if moved < 1e-12:
            break
    return model


def fit(measured: DataFrame, m: str = "m") -> Model:
    """From all rows; at most 3 ** len(RULES) counts reach the driver."""
    found = measured.groupBy(votes(m).alias("votes")).count().orderBy("votes").collect()
    return estimate({r["votes"]: r["count"] for r in found})


def posterior(model: Model, m: str = "m") -> Column:
    odds, weights, cast = F.lit(math.log(model.prior / (1 - model.prior))), model.weights().tolist(), votes(m)
    for r, (bad, good, silent) in enumerate(weights):
        vote = F.substring(cast, r + 1, 1)
        odds = odds + F.when(vote == "0", bad).when(vote == "1", good).otherwise(silent)
    return 1 / (1 + F.exp(-odds))


def base_failed(m: str = "m") -> Column:
    n = F.col(f"{m}.n_words")
    return (n < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * n)


def kept(model: Model, m: str = "m", least: float = 0.5) -> Column:
    return ~base_failed(m) & (posterior(model, m) >= least)


def judge(measured: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, the base measures, ``base_failed, kept, posterior, votes`` from rows of an id and the struct ``m``.

    A null text measures 0 throughout and fails, as the empty one does. Repeated rows and null ids each give their own
    row; a posterior of exactly one half keeps.
    """
    model = fit(measured)
    return measured.select(F.col(id_col).alias("doc_id"), *(F.col(f"m.{x}").alias(x) for x in _FIELDS[:5]), base_failed().alias("base_failed"), kept(model).alias("kept"), posterior(model).alias("posterior"), votes("m").alias("votes"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, in the same columns.

    Rows are stored with their measures, as measuring all texts again costs far more than reading them back.
    """
    measured = store(docs.select(F.struct("*").alias("row"), measures(docs, text_col).alias("m")))
    return measured.where(kept(fit(measured))).select("row.*")


#: DuckDB SQL for ``doc_id`` and the base measures.
BASE_SQL = r"""
WITH said AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS text FROM documents),
window3 AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM said)),
twice AS (
  SELECT doc_id, i FROM window3 QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS t(k) GROUP BY doc_id),
line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM said),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(s.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
       coalesce(r.n, 0)::BIGINT AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM said s LEFT JOIN dup d USING (doc_id) LEFT JOIN repeats r USING (doc_id)
"""
