"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of Unicode's White_Space.
SPACE = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.array_join(words(text), " ")


def bigrams(w: Column) -> Column:
    """Adjacent pairs of a word array, joined by one space; empty for fewer than two words.

    Two shifted slices are zipped; the array is bound once, as the one element of an outer array, so it is computed once a row.
    """
    return F.flatten(F.transform(F.array(w), _pairs))


def _pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))


def uni_bigrams(text: Column) -> Column:
    """Lower-cased words followed by their pairs."""
    return F.flatten(F.transform(F.array(words(F.lower(text))), lambda w: F.concat(w, _pairs(w))))


def slugify(text: Column) -> Column:
    """ASCII letters lower-cased, runs of other than letters and digits as one underscore, none at the ends."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def preview(text: Column, n: int = 120) -> Column:
    return F.substring(text, 1, n)


def xml_tag(xml: Column, tag: str) -> Column:
    """Content of the first <tag ...>...</tag>, or null.  A tag whose name only begins like this one is not taken."""
    found = F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.when(F.regexp_instr(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>")) > 0, found)


# The pre-tokenizer's alternatives, in order.
PRETOKEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def pretokenize(text: Column) -> Column:
    """Pieces of the byte-level BPE's regular pre-tokenizer."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def space_pieces(text: Column) -> Column:
    """The older splitter: at single spaces; pieces after the first are marked by a leading U+0120."""
    parts = F.split(text, " ")
    marked = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("Ġ"), p)))
    return F.filter(marked, lambda p: p != "")


def chunks(text: Column, n: int) -> Column:
    """Pieces of at most n UTF-8 bytes that never cut a character; n is at least 4.

    Characters are folded into the last piece while it has room: one pass in the JVM.
    """
    chars = F.split(text, "")
    start = F.array(F.lit(""))

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.octet_length(last) + F.octet_length(c) <= n
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, c)))).otherwise(F.concat(acc, F.array(c)))

    return F.filter(F.aggregate(chars, start, step), lambda x: x != "")


def think_budget(text: Column, budget: int) -> Column:
    """Closes an unclosed <think> after ``budget`` words."""
    at = F.instr(text, "<think>")
    inner = F.substring(text, at + 7, F.length(text))
    kept = F.array_join(F.slice(words(inner), 1, budget), " ")
    return F.when((at > 0) & (F.instr(text, "</think>") == 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit("<think>"), kept, F.lit("</think>"))).otherwise(text)


# Filler at the start, at the end, and what makes a last paragraph filler.
FILLER_PREFIXES = ["Okay\n", "Okay\r\n", "Okay?", "Okay!", "Okay ", "Hmm\n", "Hmm.", "Hmm,", "Hmm ", "Wait,", "Wait.", "Wait\n", "Alright\n", "Alright,", "Alright "]
FILLER_TAILS = ["okay", "hmm", "wait", "alright", "it seems your question", "let me know"]
FILLER_SUFFIXES = ["\nOkay", "\nOkay?", "\r\nOkay", "\nHmm", "\nAlright"]
# Openings of lines that are no answer.
META_STARTS = ["Okay", "Hmm", "Wait", "Let me", "User", "Need", "First", "I think", "I need", "I recall", "I should", "So,", "So ", "The user", "Now,", "Now ", "Alright", "Right", "I'm ", "Let's", "...", "---"]
#: What is said where nothing else is left.
NO_ANSWER = "Could you rephrase your question?"

_LEFT, _RIGHT = r"^\s+", r"\s+$"


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, _RIGHT, "")


def clean_filler(text: Column) -> Column:
    """Each prefix once in order, then a filler last paragraph, then each suffix once in order."""
    prefixes, suffixes = (F.array(*[F.lit(x) for x in xs]) for xs in (FILLER_PREFIXES, FILLER_SUFFIXES))
    shorter = lambda s, p: F.regexp_replace(F.substring(s, F.length(p) + 1, F.length(s)), _LEFT, "")
    s = F.aggregate(prefixes, text, lambda s, p: F.when(F.startswith(s, p), shorter(s, p)).otherwise(s))

    def tail_cut(s: Column) -> Column:
        cut = F.length(s) - F.instr(F.reverse(s), "\n\n") - 1  # characters before the last blank line
        tail = F.regexp_replace(F.substring(s, cut + 3, F.length(s)), r"^\s+|\s+$", "")
        filler = ((F.octet_length(tail) < 10) & ~F.contains(tail, F.lit("."))) | F.lower(tail).rlike("^(" + "|".join(FILLER_TAILS) + ")")
        return F.when((F.instr(s, "\n\n") > 0) & filler, _rtrim(F.substring(s, F.lit(1), cut))).otherwise(s)

    # an aggregate over one element binds its argument once
    s = F.aggregate(F.array(F.lit(0)), s, lambda acc, _: tail_cut(acc))
    less = lambda s, x: _rtrim(F.substring(s, F.lit(1), F.length(s) - F.length(x)))
    return F.aggregate(suffixes, s, lambda s, x: F.when(F.endswith(s, x), less(s, x)).otherwise(s))


def extract_answer(think: Column) -> Column:
    """The best line of a think block: sentences before statements before others, longer ones first, the last of equals."""
    lines = F.transform(F.split(think, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def meta(x: Column) -> Column:
        c = F.lit(False)
        for p in META_STARTS:
            c = c | F.startswith(x, F.lit(p))
        return c

    size = lambda x: F.least(F.octet_length(x), F.lit(200))
    verb = lambda x: F.contains(x, F.lit(" is ")) | F.contains(x, F.lit(" are ")) | F.contains(x, F.lit(" was "))
    score = lambda x: size(x) + F.when(F.endswith(x, F.lit(".")) | F.endswith(x, F.lit("!")), 100).when(verb(x), 80).otherwise(0)
    rated = F.transform(lines, lambda x, i: F.struct(score(x).alias("s"), i.alias("i"), x.alias("x")))
    good = F.filter(rated, lambda r: (F.octet_length(r["x"]) >= 8) & ~meta(r["x"]))
    first = F.get(F.filter(lines, lambda x: F.octet_length(x) > 15), F.lit(0))
    return F.coalesce(F.array_max(good)["x"], first, F.lit(NO_ANSWER))


def strip_think(text: Column) -> Column:
    """The answer without think blocks; from the last block itself where nothing else is left."""
    block = r"(?s)<think>(.*?)(?:</think>|</think(?!>)|\z)"
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|</think|\z)", ""), "</think>?", "")
    answer = clean_filler(F.regexp_replace(rest, r"^\s+|\s+$", ""))
    blocks = F.regexp_extract_all(text, F.lit(block), F.lit(1))
    last = F.regexp_replace(F.get(blocks, F.size(blocks) - 1), r"^\s+|\s+$", "")
    return F.when(answer != "", answer).when(F.coalesce(last, F.lit("")) != "", extract_answer(last)).otherwise(F.lit(NO_ANSWER))


def template_of(model_id: Column, special_tokens: Column) -> Column:
    """Chat template: by special tokens, else by the model's name."""
    low = F.lower(model_id)
    return (
        F.when(F.array_contains(special_tokens, "<|im_start|>"), "chatml")
        .when(F.array_contains(special_tokens, "<|start_header_id|>"), "llama3")
        .when(F.contains(low, F.lit("llama")) & F.contains(low, F.lit("3")), "llama3")
        .otherwise("chatml")
    )


def model_family(model_id: Column) -> Column:
    """Configuration name for a model id, first match."""
    low = F.lower(model_id)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("135m"), "small_135m").when(has("1.7b") | has("1b7"), "small_1b7").when(has("olmo") & has("7b"), "olmo_7b").when(has("olmo"), "olmo_1b").when(has("llama"), "llama_1b").otherwise("small_135m")


def training_text(source: Column, title: Column, quality: Column) -> Column:
    return F.format_string("[%s] %s (quality=%.2f)", F.upper(source), title, quality)
