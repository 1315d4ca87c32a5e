"""Scalar text functions as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: CJK ideographs, kana, hangul and extension A.
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3400}-\x{4DBF}]"
CHARS_A_TOKEN = 3.5


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def heuristic_tokens(x: Column | str) -> Column:
    """0 for an empty text, else CJK characters plus the others by 3.5, cut to a whole number, 1 at least."""
    x = _c(x)
    other = F.length(F.regexp_replace(x, CJK, ""))
    n = (F.length(x) - other + other / F.lit(CHARS_A_TOKEN)).cast("int")
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(n, F.lit(1)))


def n_words(x: Column | str) -> Column:
    return F.regexp_count(_c(x), F.lit(r"\S+"))


def n_lines(x: Column | str) -> Column:
    """Lines that aren't empty."""
    return F.regexp_count(_c(x), F.lit(r"[^\n]+"))


def n_chars(x: Column | str) -> Column:
    return F.length(_c(x))


#: Size functions by name.
SIZES: dict[str, Callable[[Column | str], Column]] = {"heuristic": heuristic_tokens, "words": n_words, "lines": n_lines, "chars": n_chars}


def size_function(name: str) -> Callable[[Column | str], Column]:
    if name not in SIZES:
        raise ValueError(f"unknown size function {name!r}; there are {sorted(SIZES)}")
    return SIZES[name]


def register_size(name: str, function: Callable[[Column | str], Column]) -> None:
    SIZES[name] = function


@lru_cache(maxsize=8)
def _counter(path: str) -> Callable[[str], int]:
    """Tokens of a text by a tokenizer's file, loaded once in each process: a JSON of the tokenizers library, or ranks for tiktoken."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(encoding.encode_ordinary(t))


def token_counter(path: str) -> Callable[[str], int]:
    """A size function of single texts, as the chunker takes them (chunking.register_size); it loads the file where it is called first."""
    return lambda t: _counter(path)(t) if t else 0


def register_tokenizer(name: str, path: str) -> None:
    """A size function of columns by a tokenizer's file, which all executors have to have at this path."""
    count = token_counter(path)

    def run(texts):
        return texts.map(lambda t: count(t) if t is not None else None).astype("Int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    register_size(name, lambda x: F.pandas_udf(run, "int")(_c(x)))


def doc_id_of(path: Column | str) -> Column:
    return F.substring(F.sha1(_c(path).cast("binary")), 1, 16)


def content_hash(content: Column | str) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def chunk_uid(doc_id: Column | str, index: Column | str) -> Column:
    return F.concat_ws(":", _c(doc_id).cast("string"), _c(index).cast("string"))


def stable_id(*parts: Column | str) -> Column:
    """16 hexadecimal digits that depend on the parts only."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[_c(p).cast("string") for p in parts]).cast("binary"), 256), 1, 16)


def citation_label(file_name: Column | str, header1: Column | str, header2: Column | str, page: Column | str) -> Column:
    """File, heading and page, those that there are, with a middle dot between."""
    blank = F.lit("")
    page = _c(page)
    return F.concat_ws(
        " · ", F.nullif(_c(file_name), blank), F.coalesce(F.nullif(_c(header2), blank), F.nullif(_c(header1), blank)),
        F.when(page > 0, F.concat(F.lit("p."), page.cast("string"))),
    )


def sentences(x: Column | str) -> Column:
    """Stripped runs that end with a full-width or ASCII ! ? or a full-width stop, or at a line's end; an ASCII full stop ends none."""
    found = F.regexp_extract_all(_c(x), F.lit(r"([^。！？!?\n]+[。！？!?]?)"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def compress_markdown(x: Column | str) -> Column:
    """Runs of dashes to one, of spaces to one, stripped: for the whole document, code and tables alike."""
    return strip(F.regexp_replace(F.regexp_replace(_c(x), "-{2,}", "-"), " {2,}", " "))


def normalise_pdf(x: Column | str) -> Column:
    """Line ends, runs of blanks, hyphens at line ends and runs of empty lines put right."""
    x = F.regexp_replace(_c(x), "\r\n|\r", "\n")
    x = F.regexp_replace(x, "[ \t]+", " ")
    x = F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def escape_cell(x: Column | str, most: int = 2000) -> Column:
    """A cell of a markdown table: bars escaped, line ends to spaces, stripped, cut."""
    return F.left(strip(F.replace(F.replace(_c(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), F.lit(most))


#: Characters kept of stored texts. Fixed values.
LIMITS = {"title": 120, "session_title": 30, "comment": 2000, "answer": 8000, "error": 1000, "query": 500, "snippet": 500, "sentence": 200}


def clipped(x: Column | str, what: str) -> Column:
    return F.left(_c(x), F.lit(LIMITS[what]))
