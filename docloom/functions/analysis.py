"""Text analysis for the index and for queries: words, CJK unigrams and bigrams, stop words, optional synonyms.

Full-width letters and digits are folded to ASCII, all is lower-cased. Words are runs of letters and digits; a run of CJK characters gives
its characters and its pairs of neighbours. A stemmer for English plurals is there for those who ask for it; there is none with a dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CJK

#: The usual English stop words of an index.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their",
    "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def folded(x: Column | str) -> Column:
    """Full-width forms to ASCII, lower case."""
    c = F.col(x) if isinstance(x, str) else x
    return F.lower(F.when(c.rlike("[！-～　]"), F.translate(c, _WIDE, _NARROW)).otherwise(c))  # few texts have such forms, and looking at each character costs


def runs(x: Column | str) -> Column:
    """Runs of CJK characters and runs of other letters and digits, in order."""
    other = r"(?:(?!" + CJK + r")[\p{L}\p{N}])+"
    return F.regexp_extract_all(folded(x), F.lit(f"({CJK}+|{other})"), F.lit(1))


def singular(term: Column) -> Column:
    """An English plural's singular by Harman's rules (1991), the first that fits: -ies to -y but after a or e; -s off but after u or s (which is what -es to -e does, too). Words of up to three letters stay."""
    size = F.length(term)
    return F.when((size > 3) & term.rlike("[^ae]ies$"), F.concat(F.left(term, size - 3), F.lit("y"))).when((size > 3) & term.rlike("[^us]s$"), F.left(term, size - 1)).otherwise(term)


def inflections(term: Column) -> Column:
    """What a word may be an inflection of, the likeliest first, by the endings of English plurals, past tenses and -ing forms that Krovetz (1993) takes off: -ies to -ie or -y, -es to -e or nothing, -s off but after s; -ied to -ie or -y,
    -ed to -e, nothing or a single consonant where it is doubled; -ing the same. Words of up to three letters (-ing: five) have none."""
    size = F.length(term)
    off = lambda n, more="": F.concat(F.left(term, size - n), F.lit(more))
    single = lambda n: F.array_compact(F.array(F.when(F.substring(term, -n - 1, 1) == F.substring(term, -n - 2, 1), off(n + 1))))
    return (
        F.when(size <= 3, F.array().cast("array<string>"))
        .when(term.endswith("ies"), F.array(off(1), off(3, "y"))).when(term.endswith("es"), F.array(off(1), off(2))).when(term.endswith("s") & ~term.endswith("ss"), F.array(off(1)))
        .when(term.endswith("ied"), F.array(off(1), off(3, "y"))).when(term.endswith("ed"), F.concat(F.array(off(1), off(2)), single(2)))
        .when(term.endswith("ing") & (size > 5), F.concat(F.array(off(3, "e"), off(3)), single(3))).otherwise(F.array().cast("array<string>"))
    )


def stems(vocabulary: DataFrame) -> DataFrame:
    """term, stem of the terms of a vocabulary (term): the first of its inflections() that is in the vocabulary itself, else the term. A dictionary is not needed: a word's own corpus tells what is a word."""
    words = vocabulary.select("term").distinct()
    each = words.select("term", F.posexplode(inflections(F.col("term"))).alias("k", "stem"))
    known = each.join(words.select(F.col("term").alias("stem")), "stem").groupBy("term").agg(F.min_by("stem", "k").alias("stem"))
    return words.join(known, "term", "left").select("term", F.coalesce("stem", "term").alias("stem"))


def stemmed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with their column term replaced by its stem in table (term, stem), if it has one; of queries and postings alike."""
    rest = [c for c in rows.columns if c != "term"]
    return rows.join(table, "term", "left").select(*rest, F.coalesce("stem", "term").alias("term"))


def terms(x: Column | str, stop_words: tuple[str, ...] = STOP_WORDS, stem: bool = False) -> Column:
    """The terms of a text, repeats included. CJK runs give unigrams and bigrams. With stem, plurals become singulars after stop words are taken out; queries and index have to do alike."""
    found = runs(x)
    grams = F.transform(
        found,
        lambda r: F.when(
            r.rlike(f"^{CJK}") & (F.length(r) > 1),
            F.concat(
                F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1))),
                F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))),
            ),
        ).otherwise(F.array(r)),
    )
    flat = F.when((F.col(x) if isinstance(x, str) else x).rlike(CJK), F.flatten(grams)).otherwise(found)  # few texts have such runs, and looking at each run costs
    kept = F.filter(flat, lambda t: ~t.isin(*stop_words)) if stop_words else flat
    return F.transform(kept, singular) if stem else kept


def with_synonyms(query_terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_terms: query_id, term; synonyms: term, synonym. Adds a row for each synonym."""
    more = query_terms.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"))
    return query_terms.select("query_id", "term").unionByName(more).distinct()
