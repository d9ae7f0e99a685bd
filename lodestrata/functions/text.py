"""String functions of the transcript pipeline, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at a line's ends. Fixed values.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def word_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def slug(title: Column, max_words: int = 5, max_chars: int = 40) -> Column:
    """Lower case; what is neither word character, space nor hyphen splits; up to five words and 40 characters, the first word always; empty gives "meeting"."""
    plain = F.regexp_replace(F.lower(title), r"(?U)[^\w\s-]+", " ")
    words = F.slice(F.filter(F.split(plain, r"(?U)[\s_-]+"), lambda w: w != ""), 1, max_words)
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(acc: Column, w: Column) -> Column:
        longer = F.when(acc["s"] == "", w).otherwise(F.concat(acc["s"], F.lit("-"), w))
        over = (acc["s"] != "") & (F.length(longer) > max_chars)
        return F.struct(F.when(acc["full"] | over, acc["s"]).otherwise(longer).alias("s"), (acc["full"] | over).alias("full"))

    out = F.aggregate(words, start, add)["s"]
    return F.when(out == "", F.lit("meeting")).otherwise(out)


def fold(name: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def safe(name: Column) -> Column:
    """One underscore for each character that is no letter, digit, dot, underscore or hyphen."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def safe_squeezed(name: Column) -> Column:
    """One hyphen for each run of characters that are no letter, digit, dot, underscore or hyphen; none at the ends. For names that travel through a shell."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}._-]+", "-"), "^-+|-+$", "")


def glob_escape(path: Column) -> Column:
    """Brackets, question marks and stars, each in brackets of its own, so that they match themselves."""
    return F.regexp_replace(path, r"([\[\]?*])", "[$1]")


def stem(folder: Column) -> Column:
    """A folder's name up to its last hyphen; all of it without one."""
    return F.regexp_replace(folder, "-[^-]*$", "")


def voice_tag(win: Column, local_label: Column) -> Column:
    """w003_S01."""
    n = win.cast("string")
    return F.concat(F.lit("w"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")), F.lit("_"), local_label)


def bar(share: Column, width: int = 20) -> Column:
    """As many # as ``share`` of ``width``, halves to the even number; none below 0."""
    return F.repeat(F.lit("#"), F.bround(F.greatest(share, F.lit(0.0)) * width, 0).cast("int"))


def glossary_prompt(terms: Column, prompt: str, lead: str) -> Column:
    """A prompt with the terms (separated by commas) to spell right: ``lead`` and the terms on a line of their own, if there are any."""
    listed = F.filter(F.transform(F.split(F.coalesce(terms, F.lit("")), ","), lambda t: F.btrim(t, F.lit(SPACES))), lambda t: t != "")
    return F.when(F.size(listed) > 0, F.concat(F.lit(f"{prompt}\n{lead}"), F.array_join(listed, ", "), F.lit("."))).otherwise(prompt)


def hours(seconds: Column) -> Column:
    return seconds / 3600


def since_epoch(at: Column) -> Column:
    """Seconds since 1970 (with fractions) of a timestamp without time zone, in no session's time zone."""
    d = at.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.extract(F.lit("DAY"), d) * 86400.0 + F.extract(F.lit("HOUR"), d) * 3600.0 + F.extract(F.lit("MINUTE"), d) * 60.0 + F.extract(F.lit("SECOND"), d).cast("double")


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def tagged(label: Column, prefix: str = "G") -> Column:
    """G00, G01, ..."""
    return F.concat(F.lit(prefix), F.lpad(label.cast("string"), F.greatest(F.lit(2), F.length(label.cast("string"))), F.lit("0")))


def normal_line(text: Column) -> Column:
    """Lower case, without white space of any kind at the ends."""
    return F.lower(F.btrim(text, F.lit(SPACES)))
