"""Text expressions, all built-in."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.fixed import BOILERPLATE, LINK_ENTRY, LINK_HEADING

BLANKS = "[ \\t\u00a0]"


def normalised(text: Column) -> Column:
    """One line end, single blanks within lines but indents kept, no blanks at line ends, at most one empty line; fenced parts stay."""
    def plain(t: Column) -> Column:
        # A single blank is as it should be, and most are single.
        t = F.regexp_replace(t, f"([^ \\t\u00a0\\n])(?: {BLANKS}+|[\\t\u00a0]{BLANKS}*)", "$1 ")
        t = F.regexp_replace(t, f"{BLANKS}+\\n", "\n")
        return F.regexp_replace(t, "\\n{3,}", "\n\n")

    lf = F.regexp_replace(text, "\\r\\n?", "\n")
    parts = F.transform(F.split(lf, "```", -1), lambda t, i: F.when(i % 2 == 0, plain(t)).otherwise(t))
    return F.regexp_replace(F.array_join(parts, "```"), "^\\s+|\\s+$", "")


def without_boilerplate(text: Column) -> Column:
    """Lines that match none of the boilerplate patterns; lines in fences stay."""
    pattern = "(?i)^\\s*(?:#{1,6}\\s*|[-*+]\\s+|>\\s*)?(?:" + "|".join(BOILERPLATE) + ")"
    own = lambda t: F.array_join(F.filter(F.split(t, "\n", -1), lambda line: ~line.rlike(pattern)), "\n")
    return F.array_join(F.transform(F.split(text, "```", -1), lambda t, i: F.when(i % 2 == 0, own(t)).otherwise(t)), "```")


def without_link_list(text: Column) -> Column:
    """text without a list of other articles at its end: dated entries, blank lines between them, and the heading right above."""
    heading = "(?i)^\\s*(?:#{1,6}\\s*|[-*+]\\s+|>\\s*)?" + LINK_HEADING

    def cut(lines: Column) -> Column:
        def back(s: Column, line: Column) -> Column:
            at = s["at"] - 1
            state = lambda to, done: F.struct(at.alias("at"), to.alias("to"), F.lit(done).alias("done"))
            above = line.rlike(heading) & (s["to"] <= at + 1)
            return F.when(s["done"], s).when(~line.rlike("\\S"), state(s["to"], False)).when(line.rlike("(?i)" + LINK_ENTRY), state(at, False)).otherwise(state(F.when(above, at).otherwise(s["to"]), True))

        start = F.struct(F.size(lines).alias("at"), F.size(lines).alias("to"), F.lit(False).alias("done"))
        to = F.aggregate(F.reverse(lines), start, back)["to"]
        return F.when(to == F.size(lines), text).otherwise(F.regexp_replace(F.array_join(F.slice(lines, F.lit(1), to), "\n"), "^\\s+|\\s+$", ""))

    return F.get(F.transform(F.array(F.split(text, "\n", -1)), cut), F.lit(0))


def without_links(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")


def match_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n tokens; of a shorter text its distinct tokens."""

    def distinct(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(" ", *(F.get(t, i + k) for k in range(n))))
        return F.array_distinct(F.when(F.size(t) >= n, runs).otherwise(t))

    # Bound to a lambda's variable, the tokens are found once, not once a run; runs take them by index, as a slice would copy the array.
    return F.get(F.transform(F.array(tokens(text)), distinct), F.lit(0))


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """The shingles of text as sorted 64-bit hashes of their tokens, each once, without joining the tokens."""

    def distinct(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(n))))
        return F.sort_array(F.array_distinct(F.when(F.size(t) >= n, runs).otherwise(F.transform(t, lambda x: F.xxhash64(x)))))

    return F.get(F.transform(F.array(tokens(text)), distinct), F.lit(0))


def markers(text: Column, names: list[str]) -> Column:
    """Those of names that text holds, in order."""
    return F.filter(F.array(*map(F.lit, names)), lambda m: F.contains(text, m))


def percent(part: Column, whole: Column) -> Column:
    """Tenths of a percent, half up on the decimal value; 0.0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 1))


def is_refusal(answer: Column) -> Column:
    """Whether the whole answer says that it doesn't know."""
    t = F.rtrim(F.lower(F.trim(F.replace(answer, F.lit("’"), F.lit("'")))), F.lit(".! "))
    return t.isin("i don't know", "i do not know")


def is_short_refusal(answer: Column) -> Column:
    """Whether the answer is a refusal, or holds one and has under 250 characters."""
    low = F.lower(F.replace(answer, F.lit("’"), F.lit("'")))
    said = F.contains(low, F.lit("i don't know")) | F.contains(low, F.lit("i do not know"))
    return is_refusal(answer) | ((F.length(answer) < 250) & said)


def grade(verdict: Column) -> Column:
    """The first of the four grades that the verdict holds; null for none."""
    found = None
    for name in ("CORRECT", "PARTIAL", "WRONG", "REFUSED"):
        held = F.contains(F.upper(verdict), F.lit(name))
        found = F.when(held, name) if found is None else found.when(held, name)
    return found


def unsupported_phrases(answer: Column, context: Column, most: int = 3) -> Column:
    """Capitalised phrases of over four characters that the context doesn't hold, each once, the first few that a report shows."""
    phrases = F.regexp_extract_all(answer, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(phrases, lambda p: (F.length(p) > 4) & ~F.contains(context, p))), 1, most)


def citations(text: Column) -> Column:
    """Indices cited in single or lenticular brackets, each once, in order."""
    marks = F.regexp_extract_all(text, F.lit(r"[\[【]\s*([0-9][0-9,\s]*?)\s*(?:†[^\]】]*)?[\]】]"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(F.flatten(F.transform(marks, lambda m: F.split(m, ","))), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int")))


def comparable(text: Column) -> Column:
    """Lower case, without white space and dashes of any kind."""
    return F.regexp_replace(F.translate(F.lower(text), "‐‑‒–—−\u00a0\u202f\u2009", "------   "), r"[\s\-]+", "")


def missing(groups: Column, text: Column) -> Column:
    """Of groups of alternatives, those of which text holds none, joined by bars."""
    flat = comparable(text)
    return F.transform(F.filter(groups, lambda g: ~F.exists(g, lambda o: F.contains(flat, comparable(o)))), lambda g: F.array_join(g, " | "))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
