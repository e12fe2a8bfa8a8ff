"""Template residue, filler, error pages and script notices: positive-unlabelled naive Bayes by expectation-maximization.

Passages (sentences and lines) that match a list of trusted error and placeholder records are labelled, all others
are unlabelled. Each round scores every distinct passage of the corpus and counts features anew with the passages'
probabilities as weights, over all passages and in parallel; the model has a fixed number of hashed features. The list
serves for labels only: what comes out is decided by the model's score and a cut told by hidden trusted records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread, written

BUCKETS = 1 << 20
ROUNDS = 2
SMOOTH = 5.0
#: Log odds of one feature count at most this much, so that no single word decides.
CLIP = 8.0
#: Weight of an unlabelled passage's probability beside a trusted one.
DAMP = 0.1
#: Of the trusted records one in so many is a spy: left unlabelled, it tells where the cut must lie.
SPIES = 5
#: Share of the best value of the criterion that the cut may give away to find more.
TOLERANCE = 0.95
#: Share of the spies above 0 that stay above any cut; few spies tell little about the criterion.
KEPT = 0.9

# ---- Fixed values: forms of unfilled slots, and trusted records -----------------------------------------------------
SLOTS = [
    ("double_curly", r"\{\{\s*[\w .-]+\s*\}\}"),
    ("hash_curly", r"#\{[\w .-]+\}"),
    ("comment", r"<!--\s*[\w .-]+?\s*-->"),
    ("curly_percent", r"\{%\s*[\w .-]+\s*%\}"),
    ("angle_percent", r"<%=?\s*[\w .-]+\s*%>"),
    ("dollar_curly", r"\$\{[\w .-]+\}"),
    ("dollars", r"\$[A-Za-z]\w*\$"),
    ("percent_paren", r"%\([\w .-]+\)[sd]"),
    ("percents", r"%[A-Za-z][A-Za-z0-9]*(?:_\w+)?%"),
    ("underscores", r"__[A-Za-z]\w*?__"),
    ("ats", r"@@\w+@@"),
    ("double_square", r"\[\[[\w .-]+\]\]"),
    ("double_angle", r"<<[\w .-]+>>"),
    ("guillemets", r"«[A-Za-z]+(?:_\w+)?»"),
    ("bars", r"\|[A-Za-z]\w*\|"),
    ("square_order", r"\[(?:insert|your|enter|add|type|put|fill)\b[^\]]*\]"),
    ("escaped_angle", r"&lt;[A-Za-z]\w*&gt;"),
    ("named", r"[\[<{«](?:[A-Z][A-Z_]{2,}|[a-z]+_[a-z0-9]+)[\]>}»]"),
    ("goes_here", r"\((?:\w+ )?\w+ goes here\)"),
    ("square", r"\[[A-Za-z]\w*\]"),
    ("angle", r"<(?!image>|/|br\b|b>|i>|p>|u>|em>|strong>|span|div|a\b|sup>|sub>|h\d>|li>|ul>|ol>|td>|tr>|table>)[A-Za-z]\w+>"),
    ("curly", r"\{[A-Za-z]\w*\}"),
]
TRUSTED_NOTICES = [
    # error pages
    r"^(?:http )?(?:error )?[45]\d\d (?:not found|forbidden|internal server error|bad gateway|service unavailable|gateway time-?out|too many requests|unauthori[sz]ed|bad request)\W*$",
    r"^(?:http )?error [45]\d\d\W*$",
    r"^(?:oops\W*)?(?:page not found|this page could not be found|access denied|bad gateway|too many requests|something went wrong)\W*$",
    r"^(?:your session has expired|(?:we are|this site is) down for maintenance|the service is (?:temporarily )?unavailable|this image is no longer available|the album has been removed)\W*$",
    r"^(?:seite nicht gefunden|página no encontrada|page introuvable|страница не найдена|页面不存在|ページが見つかりません)\W*$",
    r"^(?:sign in to see this photo|checking your browser before you can see the album|if the problem persists, contact the administrator)\W*$",
    r"^(?:log in to continue|database connection failed|just a moment|verifying that you are human|your browser does not support the features required by this viewer)\W*$",
    r"^(?:this server could not finish your request|the address you asked for does not exist on this server|you lack the rights to view this gallery)\W*$",
    # scripts required
    r"^(?:please |you must |before going on, |to continue, |for the full experience,? ?)?(?:enable|activate|turn on|switch on|allow|permit|unblock) (?:client-side )?(?:javascript|js|scripts?|scripting|cookies)\b",
    r"^(?:you must|please) (?:enable|activate|turn on|switch on|allow|permit|unblock)\b.*\b(?:javascript|js|scripts|scripting|cookies)\b",
    r"^javascript is (?:disabled|required|turned off)\b", r"^this (?:site|page|app|album app) (?:requires (?:javascript|scripts)|cannot run until you enable javascript)", r"^noscript:", r"^we noticed that scripts are blocked here\W*$",
    r"^(?:bitte aktivieren sie javascript|veuillez activer javascript|active javascript para|ative o javascript|для просмотра альбома включите javascript|请启用 ?javascript|javascript ?を有効に)",
]
TRUSTED_FILLER = [
    r"^(?:(?:lorem|ipsum|dolore?|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat)\b\W*){4,}$", r"^(?:asdf|qwer)(?: (?:asdf|qwer))*\W*$", r"^x{4,}(?: x{4,})*\W*$", r"^(?:tbd\W*){2,}$", r"^todo\W+(?:write|add|insert)\b",
    r"^\[placeholder \w+\]$", r"^(?:sample caption|untitled image|no description provided yet|add your alt text|your description goes here)\W*$",
    r"^(?:no|untitled) \w+(?: \w+)?(?: provided)? yet\W*$", r"^untitled \w+\W*$", r"^insert \w+(?: \w+)? here\W*$", r"^replace this \w+(?: \w+)? with your own\W*$", r"^<\w+(?: \w+)* to be written>$",
    r"^(\w+(?: \w+)?)(?: \1){2,}\W*$", r"^your \w+(?: \w+)? goes here\W*$", r"^add your \w+(?: \w+)?\W*$", r"^this \w+(?: \w+)? is only here to fill the page\b", r"^test(?: (?:test|\d+)){2,}\W*$", r"^(?:foo|bar|baz)(?: (?:foo|bar|baz)){2,}\W*$",
    r"^type the \w+ of this \w+ here\W*$", r"^this is a dummy paragraph that will be replaced\b", r"^here comes a longer blind text\b", r"^blindtext, der später ersetzt wird\W*$", r"^texte provisoire à remplacer\W*$",
]
#: Slot forms that stand for nothing else; the other forms also occur as notation and get their weight by learning.
TRUSTED_SLOTS = ("double_curly", "hash_curly", "comment", "dollar_curly", "curly_percent", "angle_percent", "percent_paren", "ats", "double_square", "double_angle", "square_order", "goes_here", "underscores", "named", "escaped_angle", "dollars", "percents", "bars")
#: Words about words: what holds them may speak of a slot or notice, so it is no trusted record (the model decides).
ABOUT = r"\b(?:says?|said|reads?|written as|typed|prints?|means?|explains|is replaced|stands? for|notation|syntax|called|labell?ed|the words?|tutorial|manual|screenshot|example|field)\b|[\"“”「]"
# --------------------------------------------------------------------------------------------------------------------

_SLOTS = [(n, regex.compile(p, 0 if n == "named" else regex.I)) for n, p in SLOTS]
_ANY_SLOT = regex.compile("|".join(p for _, p in SLOTS), regex.I)
_NOTICE = regex.compile("|".join(f"(?:{p})" for p in TRUSTED_NOTICES), regex.I)
_FILLER = regex.compile("|".join(f"(?:{p})" for p in TRUSTED_FILLER), regex.I)
# stray characters at both ends
_STRAY = regex.compile(r"^[^\p{L}\p{N}<\[{$%@«(|_#&]+|[^\p{L}\p{N}>\]}$%@»)|_;.!?。！？]+$")
# where a capital follows a small letter, something was glued together
_GLUED = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_ABOUT = regex.compile(ABOUT, regex.I)
_QUOTED = regex.compile(r"\"([^\"]*)\"|“([^”]*)”|「([^」]*)」")
_SPOKEN = regex.compile(r"[\"“「][^\"”」]*[\"”」]")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}]+|\p{N}+")
_LETTERS = regex.compile(r"[a-z]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_INVISIBLE = regex.compile(r"[​-‏⁠﻿­]")


def tidy(passage: str) -> str:
    return " ".join(_INVISIBLE.sub("", passage).replace("<image>", " ").split())


SLOT, NOTICE, FILLER = 1, 2, 3
KINDS = 3
_IS_SLOT = zlib.crc32(b"slot") % BUCKETS


#: Pieces of which every trusted notice or filler holds one (but for repeated words); they spare most passages the patterns.
_PIECES = (
    "not found", "forbidden", "server error", "gateway", "unavailable", "too many requests", "unauthori", "bad request", "error 4", "error 5", "be found", "denied", "went wrong", "expired",
    "maintenance", "available", "been removed", "nicht gefunden", "no encontrada", "introuvable", "страница", "页面", "ページ", "sign in", "checking your", "persists", "log in", "database connection",
    "just a moment", "verifying", "does not support", "could not finish", "does not exist", "lack the rights", "script", "js", "cookies",
    "ipsum", "dolor", "amet", "adipiscing", "elit", "eiusmod", "tempor", "incididunt", "labor", "magna", "aliqu", "enim", "veniam", "quis", "nostrud", "exercitation", "ullamco", "nisi", "commodo",
    "consequat", "asdf", "qwer", "xxxx", "tbd", "todo", "placeholder", " yet", "untitled", "insert", "your own", "to be written", "goes here", "add your", "only here to fill", "type the", "dummy",
    "blind", "provisoire", "sample", "test", "foo", "baz", "no description",
)
_SLOT_HINT = regex.compile(r"[{\[<%$@|«&#]|__|goes here", regex.I)


def trusted(passage: str) -> int:
    """Kind of a trusted error or placeholder record, 0 for all other passages; what stands in quotes doesn't count."""
    passage = _SPOKEN.sub(" ", passage).strip()
    kind, low = 0, passage.lower()
    if any(map(low.__contains__, _PIECES)) or len(set(low.split())) <= 3:
        bare = _STRAY.sub("", passage)
        kind = next((k for k, pattern in ((NOTICE, _NOTICE), (FILLER, _FILLER)) if pattern.search(passage) or pattern.search(bare)), 0)
    if not kind and _SLOT_HINT.search(passage) and any(p.search(passage) for n, p in _SLOTS if n in TRUSTED_SLOTS):
        kind = SLOT
    return 0 if kind and _ABOUT.search(passage) else kind


def features(passage: str) -> list[int]:
    """Hashed features: words, word pairs, slots by form and name or their absence, words in quotes apart, size, capitals."""
    out = set()
    rest = passage
    if _SLOT_HINT.search(passage):
        for name, pattern in _SLOTS:
            found = pattern.findall(rest)
            if found:
                out.update(("slot", f"slot {name}"))
                out.update("in slot " + w for m in found for w in _LETTERS.findall(m.lower()))
                rest = pattern.sub(" ¤ ", rest)
    if not out:
        out.add("no slot")
    if any(m in rest for m in '"“「'):
        for m in _QUOTED.finditer(rest):
            out.add("quote")
            out.update("quoted " + w for w in _TOKEN.findall(m.group().lower()))
        rest = _QUOTED.sub(" ", rest)
    words = _TOKEN.findall(_GLUED.sub(" ", rest).lower())
    # a single character of a script without spaces says little; there only pairs count
    out.update(w for w in words if not (len(w) == 1 and _UNSPACED.match(w)))
    out.update("stem " + w[:5] for w in words if len(w) > 5)
    out.update(a + " " + b for a, b in zip(["^", *words], [*words, "$"]))
    out.add(f"size {min(len(words), 12) // 2}")
    if rest.isupper() and sum(c.isalpha() for c in rest) > 3:
        out.add("capitals")
    return [zlib.crc32(f.encode()) % BUCKETS for f in sorted(out)]


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passage): lines and sentences, tidied; those without words left out."""
    split = F.split(F.col(text), r"[\r\n]+|(?<=[.!?])\s+|(?<=[.!?][)\"”»])\s+(?=[\p{Lu}\p{Lo}\p{N}<\[{$%_@«|#(])|(?<=: \d)\s+(?=\p{Lu})|(?<=[。！？])")
    p = F.regexp_replace(F.regexp_replace("passage", "[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]|<image>", " "), r"[\s\p{Z}]+", " ")
    worded = F.col("passage").rlike(r"\p{L}.*\p{L}.*\p{L}|[<\[{$%@«|#_].*\p{L}")
    return docs.select(F.col(key), F.explode(split).alias("passage")).withColumn("passage", F.trim(p)).where(worded)


def featurised(distinct: DataFrame, label=trusted) -> DataFrame:
    """passage, trusted (kind, by ``label``), spy, weight (log of occurrences), features (list of ints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            sure = [label(t) for t in texts]
            spy = [s > 0 and zlib.crc32(t.encode()) % SPIES == 0 for s, t in zip(sure, texts)]
            weight = np.log2(1.0 + b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sure, pa.int32()), pa.array(spy, pa.bool_()), pa.array(weight), pa.array([features(t) for t in texts], pa.list_(pa.int32()))],
                names=["passage", "trusted", "spy", "weight", "features"],
            )

    return distinct.select("passage", "n").mapInArrow(run, "passage string, trusted int, spy boolean, weight double, features array<int>")


class NaiveBayes:
    """Log odds of each kind of residue against content, by feature and beforehand.

    ``counts`` has a row for content and one for each kind, the last column being the passages themselves. Rates are
    drawn to the feature's rate over all passages, so that a feature rare everywhere says little. Features outside
    ``at`` occur in no passage that may be residue; for all of them the same odds, ``other``, speak for content.
    """

    def __init__(self, at: np.ndarray, counts: np.ndarray):
        n = counts[:, -1]
        total = counts[:, :-1].sum(axis=0)
        rate = total / max(n.sum(), 1.0)
        log = [np.log((c + SMOOTH * rate + 1e-12) / (m + SMOOTH)) for c, m in zip(counts[:, :-1], n)]
        self.at = at.astype(np.int32)
        self.values = np.array([np.clip(np.where(total > 0, x - log[0], 0.0), -CLIP, CLIP) if m > 0 else np.zeros(len(at)) for x, m in zip(log[1:], n[1:])], np.float32)
        self.other = [float(np.clip(np.log(SMOOTH / (m + SMOOTH)), -CLIP, 0.0)) for m in n[1:]]
        self.prior = [float(np.log(m / max(n[0], 1.0))) if m > 0 else -np.inf for m in n[1:]]
        self.odds: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "odds": None}

    def kinds(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of every passage (columns) for each kind (rows), from its flat features; without a slot none is one."""
        if self.odds is None:
            self.odds = [np.full(BUCKETS, o, np.float32) for o in self.other]
            for dense, values in zip(self.odds, self.values):
                dense[self.at] = values
        rows = []
        for prior, odds in zip(self.prior, self.odds):
            ends = np.r_[0.0, np.cumsum(odds[flat], dtype=float)]
            rows.append(prior + ends[offsets[1:]] - ends[offsets[:-1]])
        slots = np.r_[0, np.cumsum(flat == _IS_SLOT)]
        rows[SLOT - 1] = np.where(slots[offsets[1:]] > slots[offsets[:-1]], rows[SLOT - 1], -np.inf)
        return np.array(rows)

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of residue of any kind."""
        return np.logaddexp.reduce(self.kinds(flat, offsets), axis=0)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _one_hot(kind: np.ndarray) -> np.ndarray:
    return (np.arange(1 + KINDS)[:, None] == kind[None, :]).astype(float)


#: Probability of residue from which a passage's features are counted one by one.
LIKELY = 0.01


def _narrow(data: DataFrame, per_core: int = 2) -> DataFrame:
    """Few tasks: each hands on up to a row per feature, so their number is the machine's, not that of the files."""
    return data.coalesce(per_core * data.sparkSession.sparkContext.defaultParallelism)


def _counted(data: DataFrame, weigh) -> NaiveBayes | None:
    """Two passes: the features of passages that may be residue, then these features counted with each passage's weights."""

    def weighed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            flat, offsets = _flat(b.column(3))
            yield flat, offsets, weigh(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool), flat, offsets) * b.column(2).to_numpy()

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, bool)
        for flat, offsets, weights in weighed(batches):
            seen[flat[np.repeat(weights[1:].sum(axis=0) > LIKELY * DAMP, np.diff(offsets))]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], names=["at"])

    columns = ("trusted", "spy", "weight", "features")
    rows = _narrow(data).select(*columns)
    # at most BUCKETS numbers, whatever the corpus
    at = np.sort(rows.mapInArrow(likely, "at int").distinct().toPandas()["at"].to_numpy(np.int64))
    if not len(at):
        return None
    shared = data.sparkSession.sparkContext.broadcast(at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        place = np.full(BUCKETS, len(at), np.int64)
        place[at] = np.arange(len(at))
        counts, passages_ = np.zeros((1 + KINDS, len(at) + 1)), np.zeros(1 + KINDS)
        for flat, offsets, weights in weighed(batches):
            cells, each = place[flat], np.diff(offsets)
            for k in range(1 + KINDS):
                if weights[k].any():
                    counts[k] += np.bincount(cells, np.repeat(weights[k], each), len(at) + 1)
            passages_ += weights.sum(axis=1)
        counts[:, len(at)] = passages_
        kinds, cells = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(cells, pa.int32()), pa.array(counts[kinds, cells])], names=["kind", "at", "n"])

    # at most (1 + KINDS) (BUCKETS + 1) rows, whatever the corpus
    summed = rows.mapInArrow(count, "kind int, at int, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 + KINDS, len(at) + 1))
    counts[summed["kind"], summed["at"]] = summed["n"]
    shared.destroy()
    return NaiveBayes(at, counts)


def fit(data: DataFrame, rounds: int = ROUNDS) -> NaiveBayes | None:
    """EM over all passages, None without trusted ones.

    Trusted passages keep their kind, but for the spies, which are left among the unlabelled throughout. Every other
    passage counts for each kind with its probability, damped by ``DAMP`` so that the kinds stay near their records.
    """
    model = _counted(data, lambda kind, spy, flat, offsets: _one_hot(np.where(spy, 0, kind)))
    for _ in range(rounds if model else 0):
        now = data.sparkSession.sparkContext.broadcast(model)

        def expect(kind, spy, flat, offsets, now=now):
            odds = np.vstack([np.zeros(len(kind)), now.value.kinds(flat, offsets)])
            p = np.exp(odds - np.logaddexp.reduce(odds, axis=0))
            p[1:] *= DAMP
            return np.where((kind > 0) & ~spy, _one_hot(kind), p)

        model = _counted(data, expect)
        now.destroy()
    return model


def outside(passage: str) -> str | None:
    """A longer sentence without what it quotes; None for all other passages."""
    if not any(len(m) > 2 for m in _SPOKEN.findall(passage)):
        return None
    rest = _SPOKEN.sub(" ", passage).strip()
    return rest if len(_SPOKEN.sub("", passage).split(" ")) >= 5 else None


def likely_residue(data: DataFrame, model: NaiveBayes | None) -> DataFrame:
    """passage, spy, score of the passages more likely residue than content (log odds above 0).

    A longer sentence scores no more than what stands outside its quotes.
    """
    shared = data.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches if m else ():
            s = m.score(*_flat(b.column(2)))
            at = np.flatnonzero(s > 0)
            texts = b.column(0).take(pa.array(at)).to_pylist()
            for k, rest in zip(at, map(outside, texts)):
                if rest is not None:
                    bare = features(rest)
                    s[k] = min(s[k], float(m.score(np.array(bare), np.array([0, len(bare)]))[0]))
            keep = pa.array(s > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(s[s > 0])], names=["passage", "spy", "score"])

    return data.select("passage", "spy", "features").mapInArrow(run, "passage string, spy boolean, score double")


def cut_score(likely: DataFrame, data: DataFrame) -> float:
    """Where residue begins: a score of 0 or more, told by the spies.

    Of all cuts the criterion recall squared / share of passages above (Lee and Liu) is best for one; the lowest cut that
    has ``TOLERANCE`` of its value and loses no more than a share of 1 - ``KEPT`` of the spies is taken. Counted per half unit of score, so a few hundred rows are looked at.
    """
    step = F.least(F.floor(F.col("score") * 2), F.lit(2000)).alias("step")
    rows = likely.groupBy(step).agg(F.count("*").alias("n"), F.count_if("spy").alias("spies")).toPandas().sort_values("step", ascending=False)
    spies = data.where("spy").count()
    if not spies or not rows["spies"].sum():
        return 0.0
    found = rows["spies"].cumsum()
    value = (found / spies) ** 2 / rows["n"].cumsum()
    rows, value = rows[found >= KEPT * found.max()], value[found >= KEPT * found.max()]
    return float(rows["step"][value >= TOLERANCE * value.max()].min()) / 2


def passage_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", label=trusted) -> tuple[DataFrame, DataFrame]:
    """(documents' passages, distinct residual passages with their score). Passages are split and featurised once."""
    parts = written(passages(spread(docs.select(key, text)), key, text))
    distinct = parts.groupBy("passage").agg(F.count("*").alias("n"))
    # a set number of partitions: the features are Python work, however few bytes the passages are
    width = max(2 * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    data = written(featurised(distinct.repartition(width), label))
    likely = cut(likely_residue(data, fit(data)))
    return parts, likely.where(F.col("score") >= cut_score(likely, data)).select("passage", "score")


def residue_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", label=trusted) -> DataFrame:
    """Keys of documents that hold at least one passage more likely residue than content, with the worst score.

    Null and blank texts are no case; copies are judged alike and come out each; a corpus without any trusted record
    has no case. A passage that only quotes such a text is content. ``label`` only labels records for learning (kind of
    a trusted record, 0 for all others): every passage, trusted or not, is judged by the model.
    """
    parts, bad = passage_scores(docs, key, text, label)
    return parts.join(bad, "passage").groupBy(key).agg(F.max("score").alias("score"), F.count("*").alias("passages"))
