"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from tessera.functions.ids import _blank_chars, _digit_map


def blanks() -> str:
    """All white space characters as one SQL string."""
    return "||".join(f"chr({ord(c)})" for c in _blank_chars())


def sql_strip(c: str) -> str:
    """c without white space at its ends."""
    return f"trim({c}, {blanks()})"


def sql_valid(c: str) -> str:
    """c is there and not blank."""
    return f"({c} IS NOT NULL AND {sql_strip(c)} <> '')"


def sql_id(c: str) -> str:
    """The number that c spells, as digits without leading zeros, else null."""
    src, dst = _digit_map()
    t = f"translate({sql_strip(c)}, '{src}', '{dst}')"
    digits = f"regexp_replace({t}, '\\.0*$', '')"
    return f"CASE WHEN regexp_full_match({t}, '[0-9]+(\\.0*)?') THEN coalesce(nullif(ltrim({digits}, '0'), ''), '0') END"


def sql_words(c: str) -> str:
    """Words of c at white space."""
    return f"list_filter(string_split_regex({c}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


def sql_word_ids(c: str, vocabulary: int = 30_000) -> str:
    """A stable id of each word of c."""
    return f"coalesce(list_transform({sql_words(c)}, lambda w: ((('0x' || substr(md5(w), 1, 8))::bigint) % {vocabulary})::int), []::int[])"


def sql_units() -> str:
    """Common table e (vec_id, v, label) of the vectors in double precision at length 1."""
    return (
        "e0 AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS w, label FROM embeddings), "
        "e AS (SELECT vec_id, label, list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-12::double)) AS v FROM e0)"
    )


def sql_top(k: int, *, self_excluded: bool = False) -> str:
    """Common tables up to t (qid, did, score, rank) of the stated query set against all vectors."""
    skip = "WHERE a.vec_id <> b.vec_id" if self_excluded else ""
    return (
        f"WITH {sql_units()}, h AS (SELECT a.vec_id AS qid, b.vec_id AS did, list_inner_product(a.v, b.v) AS score FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a CROSS JOIN e b {skip}), "
        f"t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM h QUALIFY rank <= {k}) "
    )
