"""Text predicates and normalisers as Column expressions.

Java's ``\\w`` is ASCII unless a pattern starts with ``(?U)``, so every pattern meant for all scripts does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright import rules as R


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-" else c for c in chars) + "]"


def word_key(c: Column) -> Column:
    """Lower case, word characters and apostrophes only, apostrophes stripped from the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), r"(?U)[^\w']+", ""), F.lit("'"))


def cue_key(c: Column) -> Column:
    """Lower case without punctuation, single spaces: equal for cues that read the same."""
    bare = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def phrase_key(c: Column) -> Column:
    """ASCII letters and single spaces of the lower-cased text."""
    bare = F.regexp_replace(F.replace(F.lower(c), F.lit("."), F.lit("")), "[^a-z ]+", "")
    return F.trim(F.regexp_replace(bare, " +", " "))


def letters_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


_EDGE = r"(?s)^(\s*[\"'“‘(\[¿¡«-]*)(.*?)([.,!?;:…\"'”’)\]»-]*)$"


def edge_part(c: Column, part: str) -> Column:
    """The ``lead``, ``core`` or ``trail`` of a word: what stands before, within and behind its edge marks."""
    return F.regexp_extract(c, _EDGE, {"lead": 1, "core": 2, "trail": 3}[part])


def is_sentence_end(c: Column, abbreviations: list[str] = R.ABBREVIATIONS) -> Column:
    """Ends with ? ! an ellipsis or a note, or with a full stop that no abbreviation explains; closers behind it are ignored."""
    bare = F.rtrim(F.regexp_replace(F.rtrim(c), _class(R.CLOSERS) + "+$", ""))
    return F.when(bare.rlike("[?!…♪]$"), True).otherwise(bare.endswith(".") & ~word_key(bare).isin(abbreviations))


def is_clause_end(c: Column) -> Column:
    return F.regexp_replace(F.rtrim(c), _class(R.CLOSERS) + "+$", "").rlike("[,;:–—-]$")


def is_weak_end(c: Column) -> Column:
    return c.rlike(r"(?U)[\p{L}\p{N}]$") & word_key(c).isin(R.WEAK_ENDS)


def breaks_before(c: Column) -> Column:
    return word_key(c).isin(R.BREAK_BEFORE)


def is_descriptor(c: Column) -> Column:
    """Nothing, music marks only, or all of it in brackets."""
    t = F.trim(c)
    return t.rlike(r"^[\s♪♫¶#*~.…-]*$") | (t.startswith("[") & t.endswith("]")) | (t.startswith("(") & t.endswith(")"))


def is_caps_line(c: Column) -> Column:
    """All letters are capitals, with a word of three or more, and two words or five such letters in all."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    long = F.filter(bare, lambda w: (F.length(w) >= 3) & (w != "OK"))
    total = F.aggregate(long, F.lit(0), lambda a, w: a + F.length(w))
    shouted = c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]")
    return shouted & (F.size(long) > 0) & ((F.size(words) >= 2) | (total >= 5))


def is_stock_phrase(c: Column) -> Column:
    return phrase_key(c).isin(R.STOCK_PHRASES)


def is_unpunctuated(c: Column) -> Column:
    """Four words or more without a capital or a punctuation mark."""
    return (F.regexp_count(c, F.lit("[A-Za-z']+")) >= R.REPAIR_WORDS) & ~c.rlike("[A-Z.,?!;:]")


def spoken_text(c: Column) -> Column:
    """What a listener hears of a cue: no bracketed notes, lyric lines, speaker labels or dashes."""
    bare = F.regexp_replace(c, r"\[[^\]]*\]|\([^)]*\)", " ")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: ~x.rlike("[♪♫#]"))
    dash, label = r"^[-–—]+\s*", r"^[A-Z][A-Z0-9 .'\-]{1,30}:\s*"
    cut = lambda x, pattern: F.regexp_replace(x, pattern, "")
    lines = F.transform(lines, lambda x: cut(cut(cut(x, dash), label), dash))
    joined = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return F.regexp_replace(joined, r"(?<=\d),(?=\d{3}\b)", "")


def number_words(n: Column) -> Column:
    """Array of English words for 0 to 999,999."""
    ones = F.array(*(F.lit(w) for w in "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()))
    tens = F.array(*(F.lit(w) for w in "- - twenty thirty forty fifty sixty seventy eighty ninety".split()))
    none = F.array().cast("array<string>")

    def below_hundred(x: Column) -> Column:
        rest = F.when(x % 10 > 0, F.array(F.get(ones, (x % 10).cast("int")))).otherwise(none)
        return F.when(x < 20, F.array(F.get(ones, x.cast("int")))).otherwise(F.concat(F.array(F.get(tens, F.floor(x / 10).cast("int"))), rest))

    def below_thousand(x: Column) -> Column:
        rest = F.when(x % 100 > 0, below_hundred(x % 100)).otherwise(none)
        return F.when(x < 100, below_hundred(x)).otherwise(F.concat(F.array(F.get(ones, F.floor(x / 100).cast("int")), F.lit("hundred")), rest))

    rest = F.when(n % 1000 > 0, below_thousand(n % 1000)).otherwise(none)
    return F.when(n < 1000, below_thousand(n)).otherwise(F.concat(below_thousand(F.floor(n / 1000)), F.array(F.lit("thousand")), rest))


def comparison_words(c: Column) -> Column:
    """Array of comparison tokens of one surface word: no apostrophes, numbers spelt, fillers dropped."""
    w = F.regexp_replace(F.lower(c), "['’]", "")
    number = F.try_cast(w, "bigint") if hasattr(F, "try_cast") else w.try_cast("bigint")
    pairs = F.create_map(*(F.lit(x) for kv in R.EQUIVALENTS.items() for x in kv))
    digits = w.rlike("^[0-9]+$")
    return (
        F.when(digits & (number < 1_000_000), number_words(number))
        .when(digits, F.array(w))
        .when(w.isin(R.FILLERS), F.array().cast("array<string>"))
        .otherwise(F.array(F.coalesce(F.try_element_at(pairs, w), w)))
    )


def surface_words(c: Column) -> Column:
    """Runs of letters and digits, with inner apostrophes."""
    return F.regexp_extract_all(c, F.lit(r"(?U)([^\W_]+(?:['’][^\W_]+)*)"), F.lit(1))


def language_code(c: Column) -> Column:
    """Two-letter codes as three letters where known; others in lower case."""
    codes = F.create_map(*(F.lit(x) for kv in R.LANGUAGE_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(codes, F.lower(c)), F.lower(c))


def glob_pattern(glob: str) -> str:
    """A file-name glob as a regular expression over the whole string."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or ("\\" + c if not c.isalnum() else c)
        i += 1
    return f"(?s)^{out}$"


def one_decimal(x: Column) -> Column:
    """A number of 0 or more with one decimal, rounded as its binary value is, ties to even (Java's formats round ties up)."""
    bits = 58  # a fraction near a tie has none below, and ten times it still fits a long
    unit = 1 << bits
    tenths = F.floor((x - F.floor(x)) * float(unit)).cast("bigint") * 10
    digit, rest = F.shiftright(tenths, bits), tenths.bitwiseAND(F.lit(unit - 1))
    up = (2 * rest > unit) | ((2 * rest == unit) & (digit % 2 == 1))
    total = F.floor(x).cast("bigint") * 10 + digit + up.cast("bigint")
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))
