"""The llm operators against brute force, exact round trips and small cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import binpack, bpe, leakage, overlap, pairs, queries, residue
from tessella.llm.fm_index import FMIndex, suffix_ranks

# ---- p5 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    import base64
    import os

    if not os.path.exists(bpe.DEFAULT_VOCABULARY):
        pytest.skip("vocabularies are not here")
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY.replace(".json", ".tiktoken"), "rb"))}
    return bpe.Encoder(bpe.Merges.load(bpe.DEFAULT_VOCABULARY)), tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="abe é\n\t​日😀\xa0's12<|>endoftx", max_size=60), max_size=8))
def test_bpe_equals_library(encoders, texts):
    ours, theirs = encoders
    ids, at = ours.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [theirs.encode_ordinary(t) for t in texts]


def test_bpe_long_runs_and_store(encoders):
    _, theirs = encoders
    small = bpe.Encoder(bpe.Merges.load(bpe.DEFAULT_VOCABULARY), store_words=3)
    for texts in (["a" * 9000, " " * 500 + "x"], ["the cat sat", None, ""], ["the dog <|endoftext|>"]):
        ids, at = small.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [theirs.encode_ordinary(t or "") for t in texts]


def test_bpe_table(spark, encoders):
    df = spark.createDataFrame([(1, "hello", 5), (2, None, 5), (3, "", 5), (1, "hello", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    got = [tuple(r) for r in bpe.encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(1, [31373]), (2, []), (3, []), (1, [31373]), (None, [87])], key=str)
    assert bpe.encode_corpus(df.where("doc_id > 9")).count() == 0


# ---- p6 --------------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(docs=st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=25), min_size=1, max_size=6), phrase=st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index_finds_all(docs, phrase):
    index = FMIndex([np.array(d) for d in docs], 3, sample=4)
    codes = np.zeros((1, 5), np.int64)
    codes[0, 5 - len(phrase) :] = phrase
    lo, hi = index.search(codes, np.array([len(phrase)]))
    places = sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0]))).tolist())
    assert places == sorted(int(index.starts[i]) + j for i, d in enumerate(docs) for j in range(len(d) - len(phrase) + 1) if d[j : j + len(phrase)] == phrase)


def test_suffix_ranks():
    seq = np.array([2, 1, 2, 1, 2, 0])
    assert np.argsort(suffix_ranks(seq)).tolist() == sorted(range(6), key=lambda i: tuple(seq[i:]))


QUESTION = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize(
    "text, edits, found",
    [
        (f"before {QUESTION} after", 0, True),
        ("ONE two, <b>three</b> four  five\nsix &amp; seven **eight** nine: ten eleven-twelve", None, True),
        ("one two THREE four five sex seven eight nine ten eleven twelve", 1, True),
        ("one two three four x five seven eight nine ten eleven twelve", 2, True),
        ("a two b four c six seven d nine ten e twelve", None, False),
        ("three four five six seven eight nine ten", None, True),
        ("three four five six seven eight nine", None, False),
        ("<image>" + QUESTION.replace(" ", " <image> "), 0, True),
        ("", None, False),
    ],
)
def test_leaks(spark, text, edits, found):
    docs = spark.createDataFrame([(7, text, 1), (8, text, 1), (9, None, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([("i", QUESTION + " <image>"), ("short", "one two three"), ("none", None)], "id string, question string")
    rows = leakage.find_leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == ([(7, "i"), (8, "i")] if found else [])
    if found and edits is not None:
        assert {r["edits"] for r in rows} == {edits}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1é\u0301İ-'’ <b>/&amp;#3\u200b\u00ad.\n漢ß", max_size=40))
def test_words_with_and_without_spans(text):
    words, spans = leakage.words_of(text)
    assert leakage.only_words(text) == words and len(spans) == len(words)


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(10, 16)))) for i in range(12)]
    docs = []
    for d in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        q = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            q[rng.randrange(len(q))] = rng.choice(words)
        a = rng.randrange(len(q))
        docs.append((d, " ".join(body[:5] + q[a if rng.random() < 0.5 else 0 :] + body[5:])))

    def held(text, question):
        t, q = text.split(), question.split()
        n = -(-3 * len(q) // 5)
        if any(t[j : j + n] == q[i : i + n] for i in range(len(q) - n + 1) for j in range(len(t) - n + 1)):
            return True
        return leakage.edit_within(q, t, 2) is not None

    want = {(d, i) for d, t in docs for i, q in items if held(t, q)}
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "id string, question string"), shard_words=200, items_per_pass=5)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_removal_spans(spark):
    text = f"x {QUESTION} y"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([("a", QUESTION), ("b", QUESTION + " y z z")], "id string, question string")
    r = leakage.removal_spans(leakage.find_leaks(docs, items)).first()
    assert r["items"] == 2 and [text[s["start"] : s["end"]] for s in r["spans"]] == [text[2:]]


# ---- p1 --------------------------------------------------------------------------------------------------------------

BASE = ("train-1-0-0", "The kettle in the left image is white, while the one in the right image is black.", "http://h.example/a/1.jpg", "http://h.example/b/2.png")


@pytest.mark.parametrize(
    "identifier, sentence, left, right, same",
    [
        (" DEV-1-0-0 ", BASE[1], BASE[2], BASE[3], True),
        ("dev-1-0-0", "the KETTLE in image on the left is white, whereas one in the right photo is black !", "https://www.H.example:443//a/1-640x480.JPG?utm_source=x#top", "http://h.example/b/%32.png?w=1&q=2", True),
        ("dev-1-0-0", "The kettle in the right image is white, while the one in the left image is black.", BASE[3], BASE[2], True),
        ("dev-1-0-0", "The kettle in the right image is black, while the one in the left image is white.", BASE[2], BASE[3], True),
        ("dev-1-0-0", "The ketlte in the left image is white, while the one in the right image is black.", BASE[2], BASE[3], True),
        ("dev-1-0-0", BASE[1], BASE[3], BASE[2], False),
        ("dev-1-0-0", BASE[1].replace("white", "green"), BASE[2], BASE[3], False),
        ("dev-1-0-0", BASE[1].replace("kettle", "parrot"), BASE[2], BASE[3], False),
        ("dev-1-0-0", BASE[1], BASE[2].replace("1", "3"), BASE[3], False),
        ("train-9-0-0", BASE[1], BASE[2], BASE[3], False),
        ("other-1-0-0", BASE[1], BASE[2], BASE[3], False),
        (None, BASE[1], BASE[2], BASE[3], False),
        ("dev-1-0-0", " ", BASE[2], BASE[3], False),
        ("dev-1-0-0", BASE[1], None, BASE[3], False),
    ],
)
def test_overlap(spark, identifier, sentence, left, right, same):
    df = spark.createDataFrame([(1, *BASE, "s", 0), (2, identifier, sentence, left, right, None, 0)], "row_id long, identifier string, sentence string, left_url string, right_url string, source string, class int")
    assert [(r["train_id"], r["held_id"]) for r in overlap.cross_split_pairs(df).collect()] == ([(1, 2)] if same else [])


def test_overlap_numbers_and_empty(spark):
    schema = "row_id long, identifier string, sentence string, left_url string, right_url string, source string"
    a, b = BASE[2], BASE[3]
    rows = [(1, "train-1", "There are 3 goats in the left image.", a, b, "s"), (2, "test1-1", "There are three goats in left image", a, b, "s"), (3, "test2-1", "There are four goats in the left image.", a, b, None), (4, "train-2", "There are three goats in the left image.", a, b, "s")]
    df = spark.createDataFrame(rows, schema)
    report = {(r["split"], r["source"]): (r["pairs"], r["records"]) for r in overlap.overlap_report(df).collect()}
    assert report == {("test1", "s"): (2, 1)}
    assert overlap.cross_split_pairs(df.where("row_id > 9")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=overlap.RADIUS))
def test_some_two_blocks_of_a_group_stay_equal(flips):
    hit = {f // (64 // overlap.BLOCKS) for f in flips}
    assert any(len(set(group) - hit) >= 2 for group in overlap.BLOCK_GROUPS)
    assert sorted(b for group in overlap.BLOCK_GROUPS for b in group) == list(range(overlap.BLOCKS))


def _slip_in(word, rng):
    kind, i = rng.randrange(3), rng.randrange(len(word) - 1)
    return word[:i] + (word[i + 1 :] if kind == 0 else word[i] + word[i:] if kind == 1 else word[i + 1] + word[i] + word[i + 2 :])


def test_codes_and_comparison_find_planted_slips(spark):
    """Many statements about one pair of pictures, so that the blocks are used; each recurs with one or two slips."""
    rng = random.Random(11)
    things = "kettle lantern pretzel gondola trolley hammock bicycle windmill teapot armchair pumpkin violin toolbox backpack walrus llama".split()
    places = ["beside a quiet canal", "on the lower shelf", "between two parked vans", "near a brick chimney", "along the foggy road", "under a striped awning", "behind the glass door"]
    colors = "purple crimson golden silver orange yellow turquoise".split()
    texts = [f"A {c} {t} stands {p} in the {s} image" for c in colors for t in things for p in places for s in ("left", "right")]
    rng.shuffle(texts)
    texts = texts[:600]
    rows, want = [], set()
    for i, text in enumerate(texts):
        words = text.split()
        for at in rng.sample([j for j, w in enumerate(words) if len(w) >= 5 and w not in ("image", "right")], 1 + i % 2):
            words[at] = _slip_in(words[at], rng)
        rows += [(2 * i, "train-1", text, "http://h/a", "http://h/b", "s"), (2 * i + 1, "dev-1", " ".join(words), "http://h/a", "http://h/b", "s")]
        want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "row_id long, identifier string, sentence string, left_url string, right_url string, source string")
    got = {(r["train_id"], r["held_id"]) for r in overlap.cross_split_pairs(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
    routes = {r["route"]: r["pairs"] for r in overlap.route_report(df).collect()}
    assert routes["code"] + routes.get("equal", 0) == len(got)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("no barel here", "no barrel here", True), ("3 goats", "3 boats", False), ("the sled here", "the shed here", False), ("a castle stands", "a cattle stands", False),
        ("fro sidea", "from sidea", True), ("red cup", "redcup", True), ("chiney", "chimnney", True), ("4 cups", "5 cups", False), ("sidea cup", "sideb cup", False), ("", "", True),
    ],
)
def test_same_statement(a, b, same):
    assert overlap.same_statement(a, b) is same


# ---- p2 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        ("How many?", None, "empty"), ("How many?", " ​\n", "empty"), ("How many?", "n/a", "empty"), ("How many?", "<image>", "empty"), ("How many?", "...", "empty"),
        ("How many trams?", "None.", None), ("How many trams?", "how many  trams", "copy"), ("How many trams?", "You asked: How many trams?", "copy"), ("How many trams?", "How many trams? How many trams?", "copy"),
        ("Is the tram red?", "Yes, the tram is red.", None), ("<image> Is it?", "I cannot comply with this request.", "refusal"), ("Is it?", "Sorry, I do not have the ability to look at images.", "refusal"),
        ("What does it say?", 'It says "I cannot help you with this".', None), ("Is there a goat?", "No, I can't see any goat in the left image.", None), ("Was ist zu sehen?", "Tut mir leid, das kann ich nicht.", "refusal"),
        ("Where is the goat?", "Auf dem linken Bild ist ein roter Bus vor der Bäckerei zu sehen.", "other_language"), ("Answer in German: where is the goat?", "Auf dem linken Bild ist ein roter Bus.", None),
        ("Where is the goat?", "港口旁边有一盏旧灯笼。", "other_language"), ("港口旁边能看到什么?", "港口旁边有一盏旧灯笼。", None), (None, "It is on the left.", None),
        ("Where is the goat?", "De geit staat naast het hek en is niet rood.", "other_language"), ("Where is the goat?", "Koza stoi obok płotu i nie jest czerwona.", "other_language"),
        ("Where is the goat?", "Keçi bir duvarın yanında ve kırmızı değil.", "other_language"), ("Where is the goat?", "La capra è accanto al muro e non si vede il cane.", "other_language"),
        ("Dove è la capra?", "La capra è accanto al muro.", None), ("Waar staat de geit?", "De geit staat naast het hek.", None), ("Answer in Dutch: where is the goat?", "De geit staat naast het hek en is niet rood.", None),
        ("Dove è la capra?", "Mi dispiace, non posso aiutarti.", "refusal"), ("Where is the goat?", "Content policy prevents a reply here.", "refusal"), ("Where is the goat?", "I have to pass on this question.", "refusal"),
        ("Where is the goat?", "I do not have access to the picture, so there is nothing I can tell you.", "refusal"), ("How many?", "I cannot tell for certain, but it looks like three.", None),
    ],
)
def test_pair_rules(question, answer, defect):
    assert pairs.by_rule(question, answer)[0] == defect


def test_refusals_in_long_answers():
    filler = "The goat stands near the harbor wall, and nothing moves. " * 40
    for text in ("I cannot comply with this request.", "Tut mir leid, das kann ich nicht.", "К сожалению, я не могу помочь.", "申し訳ありませんが、お答えできません。"):
        for whole in (text, filler + text, text + filler, filler + text + filler):
            assert pairs.refuses(whole.lower())
            assert not pairs.refuses(whole.replace(text, f'"{text}"').lower())
    assert not pairs.refuses(filler.lower())


@pytest.mark.parametrize("text, want", [("It reads \"Coming soon...\"", "closed"), ("Yes, at least one tram is…", "cut"), ("They are:", "cut"), ("seen from street (seen from", "cut"), ('Both "no more', "cut"), ("next to the war-", "cut"), ("It is.", "closed"), ("Two", "open"), ("It is on the left", "open"), ("These can be seen: 1. a tram 2. a goat 3.", "cut"), ("It stops at platform 3.", "closed"), ("1. a tram 2. a goat", "open")])
def test_endings(text, want):
    assert pairs.ending(text) == want


def test_broken_pairs(spark):
    nouns = [f"{a}{b}" for a in ("bar", "kettle", "lamp", "goat") for b in ("on", "er", "ish", "ton", "ley")]
    demos = [(i, f"Where is the {n}?", f"The {n} stands near the harbor wall, a little away from everything else.") for i, n in enumerate(nouns)]
    odd = [(100, "q?", "The baron stands near the harbor wa"), (101, "q?", "The baron stands near the harbor wall, a little away"), (102, "q?", "The lampton stands near the harbor wall, a little away from everything else"), (103, "q?", "Two"), (104, "A. red goat\nB. blue cup", "B. blue cup"), (105, "q?", None)]
    d = spark.createDataFrame(demos + odd, "row_id long, question string, response string")
    t = spark.createDataFrame([(1, [("human", "q"), ("gpt", None), ("gpt", "x y"), ("human", "q"), None, ("gpt", "-")]), (2, None), (3, []), (4, [("human", "q")]), (5, [("system", "s"), ("human", "q?"), ("gpt", "--")])], "row_id long, conversations array<struct<role:string,value:string>>")
    got = {(r["tab"], r["row_id"], r["turn"], r["defect"]) for r in pairs.broken_pairs(d, t).collect()}
    assert got == {("seed_demos", 100, 0, "truncated"), ("seed_demos", 101, 0, "truncated"), ("seed_demos", 105, 0, "empty"), ("training_example", 1, 0, "empty"), ("training_example", 5, 1, "empty")}
    assert pairs.broken_pairs(d.where("row_id < 0"), t.where("row_id < 0")).count() == 0


@pytest.mark.parametrize(
    "question, answer, want",
    [
        ("What does the sign next to the pretzel say?", "The sign next to ", "open"), ("What does the sign next to the pretzel say?", "the pretzel", "open"),
        ("Choose one.\nA. red goat at dusk\nB. blue cup", "A. red goat", "open"), ("Choose one.\nA. red goat\nB. blue cup", "red goat", "closed"), ("Choose one.\nred goat\nblue cup", "Blue cup", "closed"),
        ("<image>\nWhich is larger, (A) the red drum or (B) the cactus?", "the red drum", "closed"), ("Which is larger, (A) the red drum or (B) the cactus?", "(B) the cactus", "closed"),
        ("Which is larger, (A) the red drum or (B) the cactus?", "(A) the red drum or", "open"), ("Which is larger, (A) the red drum or (B) the cactus?", "the red", "open"),
    ],
)
def test_only_whole_options_are_closed(question, answer, want):
    assert pairs.by_rule(question, answer)[:2] == (None, want)


def test_answers_cut_off_within_the_question(spark):
    cut_off = [f"The {n} stands near the harbor wall along the" for n in ("goat", "lamp", "kettle")]
    rows = [(10 * k + i, f"Choose one.\nA. {t}\nB. neither", t) for k, t in enumerate(cut_off) for i in range(9)]
    rows += [(100 + k, "q?", t) for k, t in enumerate(cut_off)] + [(200, "What does the sign next to the pretzel say?", "The sign next to ")]
    d = spark.createDataFrame(rows, "row_id long, question string, response string")
    t = spark.createDataFrame([], "row_id long, conversations array<struct<role:string,value:string>>")
    assert {(r["row_id"], r["defect"]) for r in pairs.broken_pairs(d, t).collect()} == {(i, "truncated") for i in (100, 101, 102, 200)}


def test_length_limit_fires(spark):
    """Answers cut at 60 characters, at whatever place that is, among answers of all lengths."""
    rng = random.Random(17)
    words = "goat tram kettle lamp harbor wall bakery canal purple silver crimson ladder pelican wagon bridge shelf morning quiet frozen striped".split()
    whole = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 20))) + "." for _ in range(1500)]
    cut_off = [t[:60] for t in whole if len(t) > 61 and t[59].isalpha() and t[60].isalpha()][:120]
    open_ = [t[:-1] for t in whole if 40 < len(t) < 60][:60]
    rows = list(enumerate(whole + cut_off + open_))
    pairs_ = spark.createDataFrame([("seed_demos", t, pairs.ending(t)) for _, t in rows], "tab string, text string, ending string")
    assert [(r["tab"], r["size"]) for r in pairs.length_limits(pairs_).collect()] == [("seed_demos", 60)]
    d = spark.createDataFrame([(i, "q?", t) for i, t in rows], "row_id long, question string, response string")
    t = spark.createDataFrame([], "row_id long, conversations array<struct<role:string,value:string>>")
    found = {r["row_id"]: r["route"] for r in pairs.routed_pairs(d, t).collect()}
    hit = [i for i, x in rows if x in set(cut_off)]
    assert len([i for i in hit if i in found]) >= 0.95 * len(hit) and sum(found.get(i) == "limit" for i in hit) >= 0.5 * len(hit)
    assert not [i for i, x in rows if x in set(whole) and i in found]


# ---- p3 --------------------------------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 200), st.integers(1, 40), min_size=1, max_size=25))
def test_plan_covers_all_and_fits(hist):
    sizes, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    patterns, bound, _ = binpack.plan(sizes, counts, room=200, rounds=40)
    assert (sum(p * n for p, n in patterns) == counts).all()
    assert all((p * sizes).sum() <= 200 for p, _ in patterns)
    used = sum(n for _, n in patterns)
    assert used >= bound - 1e-6
    # never worse than first fit decreasing by more than a twentieth
    free: list[int] = []
    for s in sorted(np.repeat(sizes, counts), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= s), None)
        if at is None:
            free.append(200 - s)
        else:
            free[at] -= s
    assert used <= len(free) * 1.05 + 1


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(1, 60), min_size=1, max_size=12), st.randoms())
def test_knapsack_table(sizes, rng):
    sizes = np.array(sorted(sizes))
    values = np.array([rng.random() * s for s in sizes])
    room = 60
    table = binpack.Knapsack(sizes, room)
    table.solve(values)
    best = [0.0] * (room + 1)
    for j in range(1, room + 1):
        best[j] = max([best[j - 1]] + [best[j - s] + v for s, v in zip(sizes, values) if s <= j])
    assert np.allclose(table.best[: room + 1], best)
    for i, p in enumerate(table.patterns(np.arange(len(sizes)))):
        assert p[i] >= 1 and (p * sizes).sum() <= room and np.isclose((p * values).sum(), values[i] + best[room - sizes[i]])
    left = np.array([rng.randint(0, 3) for _ in sizes])
    many = binpack.within(sizes, values, left, room)
    want = np.zeros(room + 1)
    for s, v, n in zip(sizes, values, left):
        for _ in range(n):
            want[s:] = np.maximum(want[s:], want[: room + 1 - s] + v)
    assert (many <= left).all() and (many * sizes).sum() <= room and np.isclose((many * values).sum(), want.max())


@pytest.mark.parametrize("kind", ["thirds", "halves", "many", "mixed"])
def test_program_places_the_sequences(kind):
    """On large counts nearly all sequences are whole patterns of the program, and their number is close to its bound."""
    rng = np.random.default_rng(4)
    lengths = {"thirds": rng.integers(150, 600, 900), "halves": rng.normal(430, 150, 900).clip(1, 1024), "many": rng.integers(1, 250, 2000), "mixed": np.r_[rng.integers(1, 40, 300), rng.integers(300, 900, 500)]}[kind]
    sizes, counts = np.unique(lengths.astype(int), return_counts=True)
    patterns, bound, cut_ = binpack.plan(sizes, counts * 100)
    used = sum(n for _, n in patterns)
    assert (sum(p * n for p, n in patterns) == counts * 100).all()
    assert cut_ <= 0.2 * used and used <= 1.02 * bound


def test_packed(spark):
    schema = "row_id long, source string, images array<string>, image string, conversations array<struct<role:string,value:string>>"
    turn = lambda n: [("human", "x" * n), None, ("gpt", None)]
    rows = [(i, "a", None, None, turn(4 * s)) for i, s in enumerate([60, 40, 70, 30, 100, 250, 0])] + [(50, "b", ["p", None], None, turn(8)), (51, None, None, "p", None), (52, "zz", [], None, None)]
    config = spark.createDataFrame([("a", 100), ("a", 400), ("b", 600), (None, 5), ("c", None)], "name string, max_seq_len long")
    got = binpack.packed(spark.createDataFrame(rows, schema), config).collect()
    assert {r["row_id"] for r in got} == {r[0] for r in rows}
    per = {}
    for r in got:
        if r["sequence"] is not None:
            per.setdefault((r["source"], r["sequence"]), []).append(r)
    assert all(sum(x["tokens"] for x in v) <= v[0]["capacity"] for v in per.values())
    assert {r["row_id"] for r in got if r["sequence"] is None} == {51, 52}
    assert sorted(r["tokens"] for r in got if r["row_id"] == 5) == [50.0, 100.0, 100.0]
    assert [r["tokens"] for r in got if r["row_id"] == 50] == [578.0]
    assert len([k for k in per if k[0] == "a"]) <= 7
    assert binpack.packed(spark.createDataFrame([], schema), config).count() == 0


# ---- p7 --------------------------------------------------------------------------------------------------------------


def test_residue(spark):
    rng = random.Random(5)
    good = [f"The {rng.choice(['goat', 'tram', 'kettle'])} in frame {i % 7} stands {rng.choice(['near the wall', 'on the deck', 'by a canal'])} at {rng.choice(['noon', 'dusk'])}." for i in range(400)]
    about = [f'The slide explains when to enable JavaScript in a browser, next to the {n}.' for n in ("goat", "tram", "kettle") for _ in range(6)]
    bad = ["404 Not Found", "Please enable JavaScript to view this gallery.", "Error 503", "Page not found.", "lorem ipsum dolor sit amet consectetur", "A photo of {{ title }} standing.", "TODO: write the caption", "Caption: [your title]"] * 3
    docs = [(i, " ".join(good[3 * i % 400 :][:3])) for i in range(120)] + [(1000 + i, good[i] + " " + a) for i, a in enumerate(about)]
    docs += [(2000 + i, good[i] + "\n" + b) for i, b in enumerate(bad)] + [(3000, None), (3001, " "), (3002, "<image>"), (3003, 'The screen shows "404 Not Found" next to a goat by a canal.')]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("passage", F.lit("x"))
    found = {r["doc_id"] for r in residue.residue_documents(df).collect()}
    assert found == {2000 + i for i in range(len(bad))}
    assert residue.residue_documents(df.where("doc_id < 0")).count() == 0
    assert residue.residue_documents(df.where("doc_id < 1000")).count() == 0


def test_residue_outside_quotes(spark):
    rng = random.Random(7)
    good = [f"The {rng.choice(['goat', 'tram', 'kettle'])} in frame {i % 7} stands {rng.choice(['near the wall', 'on the deck', 'by a canal'])} at {rng.choice(['noon', 'dusk'])}." for i in range(300)]
    bad = ["404 Not Found", "Error 503", "A photo of {{ title }} standing."] * 4
    docs = list(enumerate(good)) + [(1000 + i, b) for i, b in enumerate(bad)]
    docs += [(2000, 'The sign says "Open" and the {{color}} tram stands in front of it.'), (2001, 'The sign says "The {{color}} tram" and the tram stands in front of it.'), (2002, 'The screen shows "404 Not Found" next to a goat by a canal.')]
    found = {r["doc_id"] for r in residue.residue_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1000 + i for i in range(len(bad))} | {2000}
    assert residue.trusted('The sign "Open" and the {{color}} tram stand in front of it.') == residue.SLOT and residue.trusted('"{{color}}"') == 0


def test_model_finds_kinds_it_was_not_told(spark):
    """Half of the pattern families are taken from the labels; their records must be found by the model all the same."""
    rng = random.Random(13)
    nouns, places = ["goat", "tram", "kettle", "lamp", "canoe"], ["near the wall", "on the deck", "by a canal", "at the gate"]
    good = [f"The {rng.choice(nouns)} in frame {i % 9} stands {rng.choice(places)} at {rng.choice(['noon', 'dusk', 'dawn'])} with {i % 31} others." for i in range(1500)]
    slots = [("{{ %s }}", 1), ("${%s}", 0), ("<%%= %s %%>", 1), ("[[%s]]", 0), ("@@%s@@", 1), ("<<%s>>", 0)]
    frames = ["A photo of %s standing there.", "Welcome, %s!", "Posted under %s today.", "The answer is %s here."]
    told, hidden = [], []
    for i in range(120):
        form, known = slots[i % 6]
        (told if known else hidden).append(frames[i // 6 % 4] % (form % rng.choice(["title", "name", "place", "caption"])))
    for i in range(60):
        verb = ["enable", "activate", "turn on", "allow"][i % 4]
        what = rng.choice(["JavaScript", "scripts", "cookies"])
        (told if i % 2 else hidden).append(f"{'Please' if i % 2 else 'To go on you have to'} {verb} {what} in your browser {'to view this gallery' if i % 3 else 'for this page'}.")
    known = lambda p: residue.trusted(p) if p in set(told) else 0
    docs = [(i, " ".join(good[3 * i : 3 * i + 3])) for i in range(500)] + [(1000 + i, good[i] + "\n" + b) for i, b in enumerate(told)] + [(2000 + i, good[i] + "\n" + b) for i, b in enumerate(hidden)]
    found = {r["doc_id"] for r in residue.residue_documents(spark.createDataFrame(docs, "doc_id long, text string"), label=known).collect()}
    assert len({i for i in found if i >= 2000}) >= 0.9 * len(hidden)
    assert len({i for i in found if 1000 <= i < 2000}) >= 0.95 * len(told)
    assert not [i for i in found if i < 1000]


def test_trusted():
    assert residue.trusted("404 Not Found") == residue.NOTICE and residue.trusted("Sample caption.") == residue.FILLER and residue.trusted("Is {{ object }} larger?") == residue.SLOT
    assert residue.trusted('A label reading "404 Not Found" hangs there.') == 0 and residue.trusted("The goat is not found at noon near the page.") == 0


# ---- very long texts ---------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    filler = " ".join(rng.choice(words) for _ in range(30_000))
    cut_in = filler[:90_000].rsplit(" ", 1)[0]
    text = f"{cut_in} {QUESTION} {filler[len(cut_in):]} {QUESTION.replace('six', 'sex')}"
    docs = spark.createDataFrame([(1, text), (2, "y" * 200_000), (3, text + "\n404 Not Found")], "doc_id long, text string")
    items = spark.createDataFrame([("i", QUESTION)], "id string, question string")
    for shard in (1000, 250_000):
        rows = leakage.find_leaks(docs, items, shard_words=shard).collect()
        assert [(r["doc_id"], r["edits"], len(r["spans"])) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(1, 0, 2), (3, 0, 2)]
        assert rows[0]["spans"][0]["start"] == len(cut_in) + 1
    plain = [(100 + i, f"The goat in frame {i % 7} stands near the {rng.choice(['wall', 'deck', 'canal'])} at {rng.choice(['noon', 'dusk'])} with {i} others.") for i in range(200)]
    more = spark.createDataFrame([*plain, (500, "Error 503"), (501, "Page not found"), (502, "403 Forbidden")], "doc_id long, text string")
    assert {r["doc_id"] for r in residue.residue_documents(docs.unionByName(more)).collect()} == {3, 500, 501, 502}
    pair = (text, "http://h/a", "http://h/b", "s")
    demos = spark.createDataFrame([(1, "train-1", *pair), (2, "dev-1", *pair)], "row_id long, identifier string, sentence string, left_url string, right_url string, source string")
    assert overlap.cross_split_pairs(demos).count() == 1
    d = spark.createDataFrame([(1, "q?", text), (2, "q?", text + ".")], "row_id long, question string, response string")
    t = spark.createDataFrame([(1, "a", [("human", text)])], "row_id long, source string, conversations array<struct<role:string,value:string>>")
    assert pairs.broken_pairs(d, t).count() == 0  # the same text with a full stop shows that nothing is missing
    packed = binpack.packed(t.withColumn("images", F.array().cast("array<string>")).withColumn("image", F.lit(None).cast("string")), spark.createDataFrame([("a", 1000)], "name string, max_seq_len long")).collect()
    assert sum(r["tokens"] for r in packed) == len(text) / 4 and len(packed) == -(-len(text) // 4000)


# ---- all -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, root, name):
    df = queries.queries()[name](spark, root)
    assert df.count() >= 0
    want = {
        "p1_found": [("row_id_a", "bigint"), ("row_id_b", "bigint")],
        "p2_found": [("tab", "string"), ("row_id", "bigint"), ("turn", "int"), ("defect", "string")],
        "p5_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p6_found": [("doc_id", "bigint"), ("item_id", "string")],
        "p7_found": [("doc_id", "bigint")],
    }
    if name in want:
        assert df.dtypes == want[name]


def test_results_dont_depend_on_partitions(spark, root):
    from tessella.session import table

    demos, training, config, docs, items = (table(spark, root, t) for t in ("seed_demos", "training_example", "mixture_config", "documents", "vqa_item"))
    rows = lambda df: sorted(map(str, df.collect()))
    for make in (
        lambda n: overlap.cross_split_pairs(demos.repartition(n)),
        lambda n: pairs.broken_pairs(demos.repartition(n), training.repartition(n)),
        lambda n: binpack.packed(training.repartition(n), config),
        lambda n: leakage.find_leaks(docs.repartition(n), items, shard_words=500),
        lambda n: bpe.encode_corpus(docs.repartition(n)),
    ):
        assert rows(make(1)) == rows(make(5))
