"""String functions over columns. Null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "<image>"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), lit(0))


def count_token(text: Column, token: str = IMAGE) -> Column:
    """Non-overlapping occurrences of a literal token."""
    return F.floor((F.length(text) - F.length(F.replace(text, lit(token), lit("")))) / len(token)).cast("int")


def repeated(token: str, times: Column) -> Column:
    return F.repeat(lit(token), F.greatest(times, lit(0)))


def pieces(text: Column, token: str = IMAGE) -> Column:
    """Text split at a literal token (always one piece more than tokens)."""
    escaped = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in token)
    return F.split(text, escaped)


def replaced_first(text: Column, token: str, to: str, n: Column | int = 1) -> Column:
    """The first ``n`` tokens replaced, the others kept."""
    p = pieces(text, token)
    joined = F.transform(p, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.when(i <= lit(n), lit(to)).otherwise(lit(token)), s)))
    return F.array_join(joined, "")


def first_tokens(text: Column, n: Column, token: str = IMAGE) -> Column:
    """Only the first ``n`` tokens kept."""
    p = pieces(text, token)
    return F.array_join(F.transform(p, lambda s, i: F.when((i > 0) & (i <= n), F.concat(lit(token), s)).otherwise(s)), "")


def numbered_tokens(text: Column, token: str = IMAGE, before: str = "(image ", after: str = ": <Image><image></Image>)") -> Column:
    """The k-th token as ``(image k: ...)``."""
    p = pieces(text, token)
    return F.array_join(F.transform(p, lambda s, i: F.when(i == 0, s).otherwise(F.concat(lit(before), i.cast("string"), lit(after), s))), "")


def missing_prepended(text: Column, wanted: Column, token: str = IMAGE) -> Column:
    """Tokens in front until there are ``wanted``."""
    return F.concat(repeated(token, wanted - count_token(text, token)), text)


def missing_after_role(text: Column, wanted: Column, roles: str = "USER:|Human:|HUMAN:", token: str = IMAGE) -> Column:
    """Missing tokens after the first role tag; without a tag the text stays."""
    head = F.regexp_extract(text, f"(?s)^(.*?(?:{roles}))", 1)
    more = repeated(token, wanted - count_token(text, token))
    return F.when(head != "", F.concat(head, more, F.substring(text, F.length(head) + 1, F.length(text)))).otherwise(text)


def stripped(text: Column, chars: str) -> Column:
    """Both ends cleared of a set of characters."""
    return F.btrim(text, lit(chars))


def bare(text: Column) -> Column:
    """Both ends cleared of white space of any kind."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def capitalized(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def first_letter_lowered(text: Column) -> Column:
    """The first alphabetic character in lower case."""
    head = F.regexp_extract(text, r"^([^\p{L}]*)", 1)
    n = F.length(head)
    return F.concat(head, F.lower(F.substring(text, n + 1, lit(1))), F.substring(text, n + 2, F.length(text)))


def as_question(text: Column) -> Column:
    """Stripped, capitalised, with a question mark at the end."""
    t = capitalized(bare(text))
    return F.when(t.endswith("?"), t).otherwise(F.concat(t, lit("?")))


def first_letter(text: Column) -> Column:
    """First alphabetic character, '' without one."""
    return F.regexp_extract(text, r"(\p{L})", 1)


def after_first(text: Column, marker: str) -> Column:
    """What follows the first occurrence of a lower-case marker, whatever its case; null without one."""
    at = F.locate(marker, F.lower(text))
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text)))


def after_last(text: Column, marker: str) -> Column:
    """What follows the last occurrence of a marker (case counts); null without one."""
    return F.when(F.contains(text, lit(marker)), F.substring_index(text, marker, -1))


def letter(i: Column) -> Column:
    """0 -> A, 1 -> B ..."""
    return F.char(lit(65) + i)


def letter_index(c: Column) -> Column:
    return F.ascii(c) - 65


def option_lines(options: Column, style: str = "({}) ", sep: str = "\n") -> Column:
    """Lettered options: style ``({}) ``, ``{}. `` or ``{}: ``."""
    before, after = style.split("{}")
    return F.array_join(F.transform(options, lambda o, i: F.concat(lit(before), letter(i), lit(after), o)), sep)


def is_lettered(option: Column, i: Column) -> Column:
    """The option names its letter already."""
    c = letter(i)
    up = F.upper(option)
    return F.contains(up, F.concat(c, lit(")"))) | F.contains(up, F.concat(c, lit(":"))) | F.contains(up, F.concat(c, lit(".")))


def without_letter(option: Column) -> Column:
    """``B: text`` -> ``text``; other options stay."""
    return F.when(option.rlike("^[A-D]:"), bare(F.substring(option, 3, 1 << 30))).otherwise(option)


def filled(template: str, **values: Column) -> Column:
    """``${name}`` and ``{name}`` replaced."""
    out = lit(template)
    for name, value in values.items():
        out = F.replace(F.replace(out, lit("${" + name + "}"), value), lit("{" + name + "}"), value)
    return out


def section(text: Column, start: str, stop: str | None = None) -> Column:
    """Between two markers (to the end without ``stop``); null if the first is missing."""
    tail = F.when(F.contains(text, lit(start)), F.substring(text, F.locate(start, text) + len(start), F.length(text)))
    return bare(F.substring_index(tail, stop, 1) if stop else tail)


def line_field(text: Column, name: str) -> Column:
    """The rest of the first line ``name: ...``; '' without one."""
    return F.regexp_extract(text, f"(?m)^{name}: ?(.*)$", 1)


def question_answer_pairs(text: Column) -> Column:
    """[{question, answer}] from a text of alternating ``Question:`` and ``Answer:`` parts."""
    parts = F.regexp_extract_all(text, lit(r"(?s)(?:Question|Answer)\s*\d*\s*:\s*(.*?)(?=\s*(?:Question|Answer)\s*\d*\s*:|\s*$)"), lit(1))
    half = F.floor(F.size(parts) / 2).cast("int")
    return F.when(half > 0, F.transform(F.sequence(lit(0), half - 1), lambda i: F.struct(F.get(parts, 2 * i).alias("question"), F.get(parts, 2 * i + 1).alias("answer")))).otherwise(
        F.array().cast("array<struct<question:string,answer:string>>")
    )


def fenced(text: Column) -> Column:
    """Content of a fenced block (```` ```json ````), the text itself without one."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", body).otherwise(text)


def braced(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; '' without them."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def named_lists(text: Column) -> Column:
    """Lines ``name: [a, b]`` as a map of arrays; lines of another form are skipped, of equal names the last counts."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.rlike("^[^:]+: [^:]*$"))
    entry = F.transform(rows, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.transform(F.split(stripped(F.substring_index(x, ": ", -1), "[]"), ","), lambda y: F.trim(y)).alias("v")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def token_estimate(text: Column) -> Column:
    """A quarter token a character."""
    return F.floor(F.length(text) / 4).cast("long")


def shortened(text: Column, keep: int = 10) -> Column:
    """Both ends with an ellipsis between, if the text is longer than both."""
    return F.when(F.length(text) > 2 * keep, F.concat(F.left(text, lit(keep)), lit("..."), F.right(text, lit(keep)))).otherwise(text)


def positions(text: Column, token: str) -> Column:
    """0-based starts of all occurrences, overlapping ones too."""
    n = F.length(text) - len(token) + 1
    every = F.when(n > 0, F.sequence(lit(1), F.greatest(n, lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(every, lambda i: F.substring(text, i, lit(len(token))) == token), lambda i: i - 1)


def segments(text: Column, images: Column, token: str = IMAGE) -> Column:
    """Text and pictures in turn, [{type, content}]; blank text is left out, surplus tokens have no picture."""
    p = pieces(text, token)
    pair = F.transform(
        p,
        lambda s, i: F.filter(
            F.array(
                F.when(F.btrim(s, lit("\n ")) != "", F.struct(lit("text").alias("type"), s.alias("content"))),
                F.when(i < F.size(images), F.struct(lit("image").alias("type"), F.get(images, i).alias("content"))),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    return F.flatten(pair)


def key_values(text: Column) -> Column:
    """``a=1 b=2`` as a map."""
    return F.str_to_map(text, lit(" "), lit("="))


def denotation(at: Column, count: Column, salt: str, key: Column, simple: bool = False) -> Column:
    """A phrase for the picture at a 0-based place, drawn from its pool; phrases for the last one join the pool."""
    from .choice import h

    pools = F.array(*[F.array(*map(F.lit, p)) for p in (SIMPLE_DENOTATIONS if simple else DENOTATIONS)])
    place = F.get(pools, at)
    named = F.concat(place, F.array(F.concat(lit("image "), (at + 1).cast("string"))))
    pool = F.when(place.isNull(), F.array(*map(F.lit, OTHER_DENOTATIONS))).otherwise(named)
    pool = F.when((count == 1) & (at == 0), F.array(lit("the image"))).when(at == count - 1, F.concat(pool, F.array(*map(F.lit, LAST_DENOTATIONS)))).otherwise(pool)
    return F.get(pool, F.pmod(h(salt, key), F.size(pool)).cast("int"))


# Phrases for a picture by its place.
DENOTATIONS = [
    ["the first image", "the initial image", "the opening image", "the foremost image", "the lead image", "the starting image", "the premiere image"],
    ["the second image", "the secondary image", "the image directly after the first"],
    ["the third image", "the third image in sequence", "the third image to come", "following the second image", "the tertiary image"],
    ["the fourth image", "the fourth image in sequence", "the image following the third image", "the fourth to come"],
    ["the fifth image", "the fifth image in sequence", "the image following the fourth image", "the fifth image to come"],
    ["the sixth image", "the sixth image in sequence", "the image following the fifth image", "the sixth image to come"],
    ["the seventh image", "the seventh image in sequence", "the image following the sixth image", "the seventh image to come", "the image of lucky number seven"],
    ["the eighth image", "the eighth image in sequence", "the image following the seventh image", "the eighth image to come"],
    ["the ninth image", "the ninth image in sequence", "the image following the eighth image", "the ninth image to come"],
    ["the tenth image", "the tenth image in sequence", "the image following the ninth image", "the tenth image to come"],
]
SIMPLE_DENOTATIONS = [
    ["the first image", "the initial image"],
    ["the second image", "the secondary image"],
    ["the third image", "the tertiary image"],
    *([f"the {n} image", f"the {n} image in sequence"] for n in ("fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")),
]
OTHER_DENOTATIONS = ["an image", "one of the images", "a picture from the series", "a photograph in the sequence", "a selected image"]
LAST_DENOTATIONS = ["the last image", "the final image", "the end image", "the last image in the series", "the final image in the sequence", "the end image of the series"]


def literal_list(text: Column) -> Column:
    """A list written as ``['a', "b"]`` as an array, read by pattern and never evaluated; null if it isn't one."""
    items = F.regexp_extract_all(text, lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), lit(0))
    inner = F.transform(items, lambda s: F.regexp_replace(F.substring(s, lit(2), F.length(s) - 2), r"\\(.)", "$1"))
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), inner)


def packed_names(name: Column, joint: str = "_cat_", ending: str = ".jpg") -> Column:
    """A file name that packs several (``dir\\a_cat_b.jpg``) as the list of their names."""
    stem = F.regexp_replace(F.substring_index(name, "\\", -1), ending.replace(".", r"\.") + "$", "")
    return F.transform(F.split(stem, joint), lambda s: F.concat(s, lit(ending)))


def placeholder_order(text: Column, tokens: dict[str, str]) -> Column:
    """[{at, kind}] of all placeholders (kind -> token) in the order in which they stand, as media lists are merged."""

    def of(kind: str, token: str) -> Column:
        return F.transform(positions(text, token), lambda i: F.struct(i.alias("at"), lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[of(k, t) for k, t in tokens.items()]))
