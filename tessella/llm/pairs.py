"""Broken prompt and response pairs: empty, truncated, refusal, copy, other language.

Empty, refusing, copying and foreign answers are told by rules on the pair. Truncated ones need the corpus: all distinct
answers are sorted, each open one (no closing mark) is held against its successor, which is the first answer it is a
prefix of if there is any; how often words end an answer or sentence and at which lengths open answers pile up does the
rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

# ---- Fixed values -------------------------------------------------------------------------------------------------
STAND_INS = {"na", "nan", "null", "nil", "undefined", "nodata", "noanswer", "noresponse", "notavailable", "noneprovided"}

REFUSALS = [
    r"\b(can ?not|can't|could not|couldn't|won't|will not|unable to|not able to|not possible for me to|isn't possible for me to|must decline to|have to decline to|decline to|rather not|refuse to|not (?:allowed|permitted) to) (?:\w+ ){0,2}?(help|assist|comply|answer|respond|view|see|look|describe|discuss|process|provide|fulfil|fulfill|complete|continue)\b(?! (?:any|that it|if it)\b)",
    r"\b(?:request|question)\b.{0,30}\b(?:cannot|can't) be (?:completed|answered|processed|fulfilled)",
    r"\bblocked by the content (?:filter|policy)",
    r"\bno answer can be given\b",
    r"\b(?:go|goes) against my (?:guidelines|policies|principles)\b",
    r"\bmy (?:guidelines|policies|instructions) (?:do not|don't) (?:allow|permit)\b",
    r"\boutside (?:of )?what i(?:'m| am) (?:permitted|allowed|able) to\b",
    r"\bdo(?:es)? not have the ability to (?:look|see|view|answer|process)\b",
    r"\bdon't have the ability to\b",
    r"\b(?:policy|policies|filters?|guidelines|rules) (?:prevents?|prohibits?|forbids?|blocks?|(?:do|does) not allow|(?:don't|doesn't) allow)\b",
    r"\bi(?:'ll| will| must| have to| need to|'d rather| would rather)? (?:have to |need to )?pass on (?:this|that|your|the question)\b",
    r"\b(?:do not|don't|does not|doesn't) have (?:any )?access to\b",
    r"\bnothing (?:that )?i can (?:tell|say|offer|answer)\b",
    r"(?:抱歉|很遗憾|遗憾的是|对不起|作为.{0,6}模型).{0,20}(?:不能|无法|没办法|不可以)|(?:我|本模型)(?:不能|无法)(?:处理|回答|查看|提供|满足|完成|协助)|无法(?:回答|处理|查看|提供|协助)|模型.{0,6}看不到",
    r"お答えできません|対応できません|お応えできません|お手伝いできません|回答できません|見ることができません|お断り|応じられません|(?:申し訳|残念).{0,20}(?:ません|できない)|言語モデル",
    r"(?:извин|к сожалению|прост).{0,60}не (?:могу|смогу|в состоянии|имею)|(?:^|\W)не (?:могу|смогу) (?:\w+ ){0,2}(?:помочь|ответить|выполнить|обработать|посмотреть|увидеть|просматривать|отвечать)|как (?:языковая модель|ии|искусственн)|вынужден\w* отказ",
    r"tut mir leid|leider (?:kann|darf|ist es mir)|kann ich (?:dir |ihnen )?leider nicht|leider nicht (?:beantworten|helfen|bearbeiten|möglich)|ich (?:kann|darf) (?:\w+ ){0,5}nicht (?:\w+ ){0,3}(?:beantworten|helfen|bearbeiten|ansehen|sehen|beschreiben|nachkommen|erfüllen)|als (?:ki\b|sprachmodell)|bedaure|bedauere",
    r"désolée?|je ne (?:peux|puis) (?:pas|malheureusement)|je ne suis pas (?:en mesure|capable|autoris)|il m'est impossible|malheureusement,? je|impossible de répondre|en tant qu(?:e modèle|'ia|'assistant)|je regrette",
    r"lo siento|lamento|no puedo (?:\w+ ){0,2}(?:ayudar|responder|cumplir|procesar|atender|ver|describir|contestar|hacer)|no (?:me )?es posible (?:responder|atender|ayudar|procesar)|como modelo de lenguaje|como (?:una )?ia\b|desafortunadamente,? no",
    r"mi (?:dispiace|spiace)|purtroppo non|non (?:posso|sono in grado di) (?:\w+ ){0,2}(?:aiutar|rispondere|vedere|descrivere|elaborare|soddisfare)|come modello linguistico",
    r"het spijt me|helaas kan ik|ik kan (?:\w+ ){0,4}niet (?:\w+ ){0,2}(?:helpen|beantwoorden|zien|bekijken|beschrijven|verwerken)|als taalmodel",
    r"przykro mi|niestety nie mogę|nie mogę (?:\w+ ){0,2}(?:odpowiedzieć|pomóc|zobaczyć|opisać|przetworzyć)|jako model językowy",
    r"üzgünüm|maalesef|yardımcı olamam|(?:yanıtlaya|cevaplaya|göre|tarif ede)m(?:em|iyorum)|dil modeli olarak",
    r"desculpe|sinto muito|lamento|infelizmente,? (?:eu )?não|não (?:posso|consigo) (?:\w+ ){0,2}(?:ajudar|responder|atender|processar|cumprir|ver|descrever)|como (?:um )?modelo de linguagem|não (?:me )?é possível (?:responder|atender|ajudar|processar)",
]

#: What an answer may say around the question it gives back.
ECHO = set("q question questions user human assistant you asked ask the is was your said again so repeat frage pregunta pergunta вопрос 问题 質問 提问".split())

FUNCTION_WORDS = {
    "en": "the a an of and or in on at is are was were be to from with by for than that this these those it its there their both each no not yes only one none how many what where which does do who than as while whereas has have left right image images behind next between any all some me about tell why might could can choose name please".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder im in auf am an ist sind war zu von mit bei für als dass dieser diese dieses es nicht ja nein nur zwischen wurde vor unter neben dahinter hier liegt steht man sieht wie viele was wo welche welches welcher welchem auf bild".split(),
    "fr": "le la les l un une des du de d et ou dans sur est sont était à au aux avec par pour que ce cette ces il y on ne pas oui non une seule entre derrière devant sous près ici voit combien quoi où quelle quel tandis".split(),
    "es": "el la los las un una unos unas de del y o en es son era a al con por para que este esta estos se no sí solo entre detrás delante bajo junto cerca aquí ve hay mientras cuántos qué dónde cuál lo su".split(),
    "it": "il lo la gli le un uno una di del della dei delle nel nella su sul sulla è sono era al alla con per che questo questa si non sì solo tra fra dietro davanti sotto accanto vicino qui vede mentre quanti quante cosa dove quale quali".split(),
    "nl": "de het een en van op aan zijn er naar met bij voor als dat die dit deze niet ja nee alleen tussen onder naast achter hier staat ligt men ziet hoeveel wat waar welke welk wordt geen maar ook".split(),
    "pl": "we na ze od nie tak jest są był to ten ta te tylko między pod obok za przed tutaj tu stoi leży widać ile co gdzie który która które oraz lub ma się dla".split(),
    "tr": "bir ve bu şu ile için da de mi mı mu mü değil evet hayır var yok yalnızca arasında altında yanında arkasında önünde burada görülüyor kaç ne nerede hangi olan gibi daha çok".split(),
    "sv": "en ett och på är var att det den de som av med för till från inte ja nej bara mellan under bredvid bakom framför här står ligger man ser hur många vad vilken vilket har".split(),
    "pt": "o a os as um uma uns umas de do da dos das e ou em no na nos nas é são era ao à com por para que este esta se não sim apenas entre atrás debaixo frente perto aqui vê há enquanto quantos onde qual lado".split(),
}
LANGUAGE_NAMES = {
    "en": r"\benglish\b|\bingl[eé]s\b|\banglais\b|englisch|английск|英语|英語",
    "de": r"\bgerman\b|deutsch|\balem[aá]n\b|\balemão\b|\ballemand\b|немецк|德语|ドイツ語",
    "fr": r"\bfrench\b|französisch|\bfrancés\b|\bfrancês\b|\bfrançais\b|французск|法语|フランス語",
    "es": r"\bspanish\b|spanisch|\bespañol\b|\bespanhol\b|\bespagnol\b|испанск|西班牙语|スペイン語",
    "pt": r"\bportuguese\b|portugiesisch|\bportugu[eéê]s\b|\bportugais\b|португальск|葡萄牙语|ポルトガル語",
    "it": r"\bitalian\b|italienisch|\bitaliano\b|\bitalien\b|итальянск|意大利语|イタリア語",
    "nl": r"\bdutch\b|niederländisch|\bholandés\b|\bholandês\b|\bnéerlandais\b|нидерландск|荷兰语|オランダ語",
    "pl": r"\bpolish\b|polnisch|\bpolaco\b|\bpolonês\b|\bpolonais\b|польск|波兰语|ポーランド語",
    "tr": r"\bturkish\b|türkisch|\bturco\b|\bturc\b|турецк|土耳其语|トルコ語",
    "sv": r"\bswedish\b|schwedisch|\bsueco\b|\bsuédois\b|шведск|瑞典语|スウェーデン語",
    "ru": r"\brussian\b|russisch|\bruso\b|\brusso\b|\brusse\b|русск|俄语|ロシア語",
    "zh": r"\bchinese\b|chinesisch|\bchino\b|\bchinês\b|\bchinois\b|китайск|中文|汉语|中国語",
    "ja": r"\bjapanese\b|japanisch|\bjaponés\b|\bjaponês\b|\bjaponais\b|японск|日语|日本語",
}
SCRIPTS = [("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ru", r"\p{Cyrillic}"), ("ko", r"\p{Hangul}"), ("ar", r"\p{Arabic}"), ("el", r"\p{Greek}"), ("he", r"\p{Hebrew}"), ("th", r"\p{Thai}"), ("hi", r"\p{Devanagari}")]
# --------------------------------------------------------------------------------------------------------------------

_INVISIBLE = regex.compile(r"[​-‏⁠﻿­]")
_IMAGE = regex.compile(r"<image>", regex.I)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_QUOTED = regex.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|「[^」]*」|„[^“”]*[“”]")
_REFUSAL = regex.compile("|".join(f"(?:{p})" for p in REFUSALS))  # of lower-case texts
_SCRIPTS = [(name, regex.compile(p)) for name, p in SCRIPTS]
_LETTER = regex.compile(r"\p{L}")
_NAMES = {k: regex.compile(v, regex.I) for k, v in LANGUAGE_NAMES.items()}
_WORDS_OF = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: A letter or number before a choice, and what joins a choice to the next one.
_MARKER = re.compile(r"(?<!\S)\(?(?:[a-z]|\d{1,2})[.):]\s+")
_JOINED = re.compile(r"[\s,;/]*(?:(?<=[\s,;/])(?:or|and|oder|und|ou|o|et|y|e))?[\s,;/]*$")
_CLOSING = tuple(".!?。！？．\"”»」』)）'’")
_CUT_MARKS = tuple(",;:、，；：-–—‐(（[{\"“«「„…")


#: Pieces of which every refusal holds at least one; only what stands around them is matched with the patterns.
_REFUSAL_PIECES = (
    "cannot", "can not", "can't", "could not", "couldn't", "won't", "will not", "able to", "possible for me", "decline to", "rather not", "refuse to", "not allowed", "not permitted",
    "content filter", "content policy", "no answer can", "against my", "my guidelines", "my policies", "my instructions", "outside", "have the ability",
    "prevent", "prohibit", "forbid", "blocks", "blocked by", "not allow", "n't allow", "pass on", "access to", "nothing i can", "nothing that i can",
    "不能", "无法", "没办法", "不可以", "看不到", "できません", "お断り", "応じられ", "申し訳", "残念", "言語モデル",
    "не могу", "не смогу", "не в состоянии", "не имею", "языковая модель", "как ии", "искусственн", "отказ",
    "tut mir", "leider", "ich kann", "ich darf", "als ki", "als sprachmodell", "bedau", "désol", "je ne", "m'est", "malheureusement", "impossible", "en tant", "regrette",
    "lo siento", "lamento", "no puedo", "es posible", "modelo de", "como ia", "como una ia", "desafort", "desculpe", "sinto muito", "infelizmente", "não posso", "não consigo", "é possível",
    "dispiace", "spiace", "purtroppo", "non posso", "non sono", "modello", "het spijt", "helaas", "ik kan", "taalmodel", "przykro", "niestety", "nie mog", "model językowy",
    "üzgünüm", "maalesef", "olamam", "yanıtlayam", "cevaplayam", "görem", "tarif edem", "dil modeli",
)
#: Characters around a piece within which every pattern that holds it lies.
_AROUND = 200


def refuses(low: str) -> bool:
    """A lower-case answer declines; what it quotes doesn't count."""
    if not any(map(low.__contains__, _REFUSAL_PIECES)):
        return False
    low = _QUOTED.sub(" ", low) if any(m in low for m in _MARKS) else low
    low = low.replace("’", "'")
    if len(low) <= 2 * _AROUND:
        return _REFUSAL.search(low) is not None
    spans: list[list[int]] = []
    for at in sorted(m.start() for m in _PIECE.finditer(low)):
        if spans and at - _AROUND <= spans[-1][1]:
            spans[-1][1] = at + _AROUND
        else:
            spans.append([max(0, at - _AROUND), at + _AROUND])
    return any(_REFUSAL.search(low[a:b]) for a, b in spans)


_PIECE = re.compile("|".join(map(re.escape, _REFUSAL_PIECES)))
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_LANGUAGES = list(FUNCTION_WORDS)
_LANGUAGES_OF = {w: tuple(i for i, k in enumerate(_LANGUAGES) if w in _WORDS_OF[k]) for s in FUNCTION_WORDS.values() for w in s}
_MARKS = '"“«「„'


def tidy(text: str | None) -> str:
    text = text or ""
    if "<" in text:
        text = _IMAGE.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return " ".join(text.split())


def words_in(text: str) -> list[str]:
    return _ASCII_WORD.findall(text.lower()) if text.isascii() else _WORD.findall(text.lower())


def language(text: str, words: list[str] | None = None) -> str | None:
    """Language of a text by script and function words; None if the text doesn't tell. Quoted words don't count."""
    if any(m in text for m in _MARKS):
        text, words = _QUOTED.sub(" ", text), None
    if not text.isascii():
        letters = len(_LETTER.findall(text))
        for name, pattern in _SCRIPTS:
            n = len(pattern.findall(text))
            if n and (n >= 0.3 * letters or (name == "ja" and n >= 0.1 * letters)):
                return name
    words = words_in(text) if words is None else words
    score = [0] * len(_LANGUAGES)
    for w in words:
        for i in _LANGUAGES_OF.get(w, ()):
            score[i] += 1
    ranked = sorted(score)
    best, second = ranked[-1], ranked[-2]
    if best > second and best >= 2 or best == 1 and second == 0 and len(words) <= 4:
        return _LANGUAGES[score.index(best)]
    return None


@lru_cache(maxsize=50_000)
def _asked(question: str | None) -> tuple[str, list[str], str, str | None]:
    q = tidy(question)
    words = words_in(q)
    return q, words, "".join(words), language(q, words)


@lru_cache(maxsize=50_000)
def _options(question: str | None) -> frozenset[str]:
    """Whole choices of a question: what follows each of at least two letters or numbers, with or without them, and full lines but the first."""
    lines = [t for t in map(tidy, (question or "").lower().splitlines()) if words_in(t)]
    out = set(lines[1:])
    marks = [list(_MARKER.finditer(t)) for t in lines]
    if sum(map(len, marks)) >= 2:
        for line, found in zip(lines, marks):
            for m, end in zip(found, [*(n.start() for n in found[1:]), len(line)]):
                choice = _JOINED.sub("", line[m.end() : end].split("?")[0])
                out.update((choice, line[m.start() : m.end()] + choice))
    return frozenset(out)


_LAST_MARKER = re.compile(r"(?:^|\s)\(?(\d{1,3})[.)]$")


def _announced(text: str) -> bool:
    """The text ends with the number of a list item that doesn't come."""
    last = _LAST_MARKER.search(text)
    return bool(last) and re.search(rf"(?:^|\s)\(?{int(last[1]) - 1}[.)]\s", text) is not None


def ending(text: str) -> str:
    """'closed', 'cut' (breaks off visibly) or 'open' (no closing mark; the corpus must tell)."""
    if text[-2:-1].isdigit() and _announced(text):
        return "cut"
    if text.endswith(("...", "…")) or text.endswith("..") and len(text) > 2:
        return "cut"
    if text.endswith(_CLOSING):
        if text[-1] == '"' and text.count('"') % 2:
            return "cut"
        return "closed"
    if text.endswith(_CUT_MARKS):
        return "cut"
    if text.count("(") > text.count(")") or text.count('"') % 2 or text.count("“") > text.count("”") or text.count("«") > text.count("»") or text.count("「") > text.count("」"):
        return "cut"
    return "open"


def by_rule(question: str | None, answer: str | None) -> tuple[str | None, str, str]:
    """(defect told by the pair alone, ending, answer without pictures and odd spacing)."""
    a = tidy(answer)
    words = words_in(a)
    compact = "".join(words)
    if not compact or compact in STAND_INS:
        return "empty", "closed", a
    low = a.lower()
    if refuses(low):
        return "refusal", "closed", a
    q, q_words, asked, here = _asked(question)
    if asked and asked in compact:
        rest, bare = " ".join(words), " ".join(q_words)
        rest = rest.replace(bare, " ") if bare in rest else compact.replace(asked, " ")
        if all(w in ECHO for w in rest.split()):
            return "copy", "closed", a
    if here:
        there = language(a, words)
        if there and here != there and not ({here, there} == {"ja", "zh"} and len(compact) < 6):
            name = _NAMES.get(there)
            if not (name and name.search(q)):
                return "other_language", "closed", a
    if low in q.lower() and low in _options(question):
        return None, "closed", a
    return None, ending(a), a


def answer_pairs(demos: DataFrame, training: DataFrame) -> DataFrame:
    """tab, row_id, turn, q, a of every pair: question and response; a human turn directly followed by a gpt turn."""
    first = demos.select(F.lit("seed_demos").alias("tab"), "row_id", F.lit(0).alias("turn"), F.col("question").alias("q"), F.col("response").alias("a"))
    n = F.size("conversations") - 1
    both = F.arrays_zip(F.slice("conversations", 1, n).alias("h"), F.slice("conversations", 2, n).alias("g"))
    turns = training.where(n >= 1).select("row_id", F.posexplode(both).alias("turn", "t"))
    turns = turns.where((F.col("t.h.role") == "human") & (F.col("t.g.role") == "gpt"))
    return first.unionByName(turns.select(F.lit("training_example").alias("tab"), "row_id", "turn", F.col("t.h.value").alias("q"), F.col("t.g.value").alias("a")))


_TOKENS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}]+|[.!?。！？]"
_STOPS = (".", "!", "?", "。", "！", "？")


_ASCII_TOKEN = re.compile(r"[a-z0-9]+|[.!?]")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}]+|[.!?。！？]")
#: Word pairs counted by a Python worker before it hands them on.
_HELD_PAIRS = 300_000


def continuations(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How often sentences end with a word (v: n1, e1) and with two words in a row (u, v: n2, e2), and how often they end
    one or two words after two words (u, v: n, s1, s2), over distinct answers.

    A word at the very end without a closing mark counts for nothing. Counts are combined in the workers first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], list[int]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, *c) for k, c in counts.items()], columns=["u", "v", "n2", "e2", "n", "s1", "s2"])

        for b in batches:
            for text in b["text"]:
                low = text.lower()
                t = (_ASCII_TOKEN if low.isascii() else _TOKEN).findall(low)
                ends = [w in _STOPS for w in t]
                last = len(t) - 1
                for i in range(last):
                    if ends[i]:
                        continue
                    c = counts.setdefault((t[i - 1] if i else "", t[i]), [0, 0, 0, 0, 0])
                    c[0] += 1
                    if ends[i + 1]:
                        c[1] += 1
                        c[2] += i + 2 <= last
                    elif i + 2 <= last:
                        c[2] += 1
                        if ends[i + 2]:
                            c[3] += 1
                        elif i + 3 <= last and ends[i + 3]:
                            c[4] += 1
            if len(counts) > _HELD_PAIRS:
                yield rows()
                counts.clear()
        yield rows()

    sums = ("n2", "e2", "n", "s1", "s2")
    two = cut(spread(answers.select("text")).mapInPandas(run, "u string, v string, n2 long, e2 long, n long, s1 long, s2 long").groupBy("u", "v").agg(*[F.sum(c).alias(c) for c in sums]))
    known = two.where("u <> ''")
    return two.groupBy("v").agg(F.sum("n2").alias("n1"), F.sum("e2").alias("e1")), known.select("u", "v", "n2", "e2"), known.where("n >= 20").select("u", "v", "n", "s1", "s2")


def extensions(answers: DataFrame) -> DataFrame:
    """(text, extended): for open answers, how the next answer in text order goes on: 'word', 'inside' a word or null.

    All answers that begin with a text follow it at once in sorted order, so one neighbour is enough. Partitions are
    ranges of the order; the first text of each (one row a partition) tells the last text of the one before.
    """
    ranged = cut(answers.select("text", "ending").repartitionByRange("text").sortWithinPartitions("text"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "head": [b["text"].iloc[0]]})
                break
        for _ in batches:
            pass

    first = {r[0]: r[1] for r in ranged.mapInPandas(heads, "part int, head string").collect()}
    order = sorted(first)
    follow = {p: first[q] for p, q in zip(order, order[1:])}
    shared = answers.sparkSession.sparkContext.broadcast(follow)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def judged(rows: list[tuple[str, str]]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["text", "extended"])

        held = None
        for b in batches:
            out, texts, ends = [], b["text"].tolist(), b["ending"].tolist()
            if held:
                texts, ends = [held[0], *texts], [held[1], *ends]
            for i in range(len(texts) - 1):
                if ends[i] == "open":
                    out.append((texts[i], _goes_on(texts[i], texts[i + 1])))
            held = (texts[-1], ends[-1]) if texts else held
            yield judged(out)
        if held and held[1] == "open":
            yield judged([(held[0], _goes_on(held[0], shared.value.get(TaskContext.get().partitionId())))])

    return ranged.mapInPandas(neighbours, "text string, extended string")


def _goes_on(text: str, after: str | None) -> str | None:
    if not after or not after.startswith(text) or len(after) == len(text):
        return None
    c = after[len(text)]
    return "inside" if c.isalnum() else "word" if c in " ,;:、，；" and len(after) > len(text) + 2 else None


#: Standard deviations above its neighbours from which a length is a limit.
SPIKE = 6.0
#: Share of a table's open answers that a limit cuts at least; answers below ``LONG`` characters only serve as neighbours.
SPIKE_SHARE, LONG = 0.02, 40


def length_limits(pairs: DataFrame) -> DataFrame:
    """(tab, size): lengths at which distinct open answers pile up, as a limit on the length of answers makes them: more
    than ``SPIKE`` deviations above what the six lengths on either side let expect (counts vary by their root), and at
    least ``SPIKE_SHARE`` of all."""
    hist = pairs.where((F.col("ending") == "open") & (F.length("text") >= LONG - 6)).groupBy("tab", F.length("text").alias("size")).agg(F.count_distinct("text").alias("n"))
    # at most a row for each length that occurs, whatever the number of answers
    around = Window.partitionBy("tab").orderBy("size").rangeBetween(-6, 6)
    expected = (F.sum("n").over(around) - F.col("n")) / 12
    hist = hist.withColumn("expected", expected).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tab")))
    spike = F.col("n") - F.col("expected") > SPIKE * F.sqrt(F.col("expected") + 1)
    return hist.where(spike & (F.col("share") >= SPIKE_SHARE) & (F.col("size") >= LONG)).select("tab", "size")


def broken_pairs(demos: DataFrame, training: DataFrame) -> DataFrame:
    """tab, row_id, turn, defect of each defective pair, one defect a pair, in the order empty, refusal, copy,
    other_language, truncated.

    Null answers, answers without words and stand-ins for missing values are empty; a null or empty question leaves
    copy and language untold; short answers and those that lack only the full stop are no defect. Rows delivered twice
    come out twice. Null conversations and null turns hold no pair.
    """
    return routed_pairs(demos, training).drop("route")


def routed_pairs(demos: DataFrame, training: DataFrame) -> DataFrame:
    """``broken_pairs`` with the ``route`` that found the pair: 'rule', for truncated ones 'mark' (breaks off visibly),
    'limit' (a length limit), 'neighbour' (the next answer in text order goes on) or 'ends' (its last words never end)."""
    pairs = spread(answer_pairs(demos, training))

    @F.pandas_udf("defect string, ending string, text string")
    def rule(q: pd.Series, a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([by_rule(x, y) for x, y in zip(q, a)], columns=["defect", "ending", "text"])

    told = cut(pairs.withColumn("r", rule("q", "a")).select("tab", "row_id", "turn", "r.*"))
    found = told.withColumn("defect", F.coalesce("defect", F.when(F.col("ending") == "cut", "truncated")))
    whole = told.where(F.col("defect").isNull() & (F.col("text") != ""))
    # 'open' above 'closed': a text that is a choice of one question may break off under another
    answers = cut(whole.groupBy("text").agg(F.max("ending").alias("ending")))
    broken = truncated_texts(answers, length_limits(whole.select("tab", "text", "ending")), whole)
    rest = found.where(F.col("defect").isNull() & (F.col("ending") == "open")).join(broken, "text")
    route = F.when(F.col("defect") == "truncated", "mark").otherwise("rule")
    return (
        found.where(F.col("defect").isNotNull()).select("tab", "row_id", "turn", "defect", route.alias("route"))
        .unionByName(rest.select("tab", "row_id", "turn", F.lit("truncated").alias("defect"), "route"))
    )


#: Words no answer ends with.
_NEVER_LAST = sorted(set("the a an of and or in on at is are was were to from with by than that its it there has have shows both each no between across along beside near under inside behind".split()))


def truncated_texts(answers: DataFrame, limits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text, route) of open answers that break off, each text once."""
    one, two, later = continuations(answers)
    open_ = answers.where(F.col("ending") == "open").select("text")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(_TOKENS), F.lit(0))
    open_ = open_.withColumn("t", tokens).select("text", F.size("t").alias("words"), *(F.try_element_at("t", F.lit(-n)).alias(c) for n, c in ((1, "v"), (2, "u"), (3, "p"), (4, "o"))))
    closed = answers.where(F.col("ending") == "closed").select(F.regexp_replace("text", "[.!?。！？]+$", "").alias("text")).distinct().withColumn("complete", F.lit(True))
    at_limit = pairs.where(F.col("ending") == "open").join(limits, (pairs["tab"] == limits["tab"]) & (F.length("text") == limits["size"])).select("text").distinct().withColumn("limit", F.lit(True))
    x = open_.join(extensions(answers), "text", "left").join(closed, "text", "left").join(at_limit, "text", "left")
    x = x.join(two, ["u", "v"], "left").join(one, "v", "left")
    # with the last word, or the last two, left open
    x = x.join(later.select(F.col("u").alias("p"), F.col("v").alias("u"), (F.col("s1") / F.col("n")).alias("after1")), ["p", "u"], "left")
    x = x.join(later.select(F.col("u").alias("o"), F.col("v").alias("p"), (F.col("s2") / F.col("n")).alias("after2")), ["o", "p"], "left")
    x = x.na.fill(0, ["n1", "e1", "n2", "e2", "after1", "after2"])
    x = x.where(F.col("complete").isNull())
    known = F.when(F.col("n2") >= 3, F.col("e2") >= 0.02 * F.col("n2")).when(F.col("n1") >= 3, F.col("e1") >= 0.02 * F.col("n1")).otherwise(False)
    known = known | (F.col("n1") >= 3) & (F.greatest("after1", "after2") >= 0.3)
    long = F.col("words") >= 4
    by_limit = long & F.col("limit").isNotNull() & ((F.col("e2") < 0.2 * F.col("n2")) | (F.col("n1") == 0))
    by_neighbour = ((F.col("words") >= 2) & (F.col("extended") == "inside") & ((F.col("n1") < 2) | long & (F.col("e2") == 0))) | (long & (F.col("extended") == "word"))
    by_ends = ((F.col("words") >= 2) & F.col("v").isin(_NEVER_LAST)) | (long & ~known)
    route = F.when(by_limit, "limit").when(by_neighbour, "neighbour").when(by_ends, "ends")
    return x.select("text", route.alias("route")).where("route is not null").dropDuplicates(["text"])
