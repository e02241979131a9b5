"""Features of contract sources as expressions over the joined text of a package's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "[A-Za-z_][A-Za-z0-9_]*"
# Patterns of the features.
COUNTS = {
    "n_functions": r"\bfunction\s+[a-zA-Z0-9_]+\s*\(", "n_events": r"\bevent\s+[a-zA-Z0-9_]+\s*\(", "n_mappings": r"\bmapping\s*\(", "n_arrays": r"\[[^\]]*\]", "n_imports": r"\bimport\b",
    "n_modifiers": rf"\bmodifier\s+{NAME}\s*\(", "n_constructors": r"\bconstructor\s*\(", "n_contracts": rf"\bcontract\s+({NAME})\b", "n_interfaces": rf"\binterface\s+({NAME})\b", "n_abstract": r"\babstract\s+contract\b",
}
# Patterns of the flags, of library use, and of the ends of lines.
FLAGS = {
    "has_create": r"(?i)\bcreate\s*\(", "has_create2": r"(?i)\bcreate2\s*\(", "has_clone": r"(?i)\bclone\s*\(", "has_predict": r"(?i)\bpredict\w*\s*\(", "has_salt": r"(?i)\bbytes32\s+salt\b|(?i)CREATE2", "has_delegatecall": r"(?i)\bdelegatecall\b",
    "has_openzeppelin": r"(?i)openzeppelin", "has_ownable": r"\bOwnable\b", "has_access_control": r"\bAccessControl\b", "has_only_owner": r"\bonlyOwner\b",
}
USING, LIBRARY = rf"\busing\s+({NAME})\s+for\b", rf"\blibrary\s+({NAME})\b"
# Libraries, business terms and name tokens that are looked for.
LIBRARIES = "SafeMath Address ECDSA Strings Clones Create2 Math EnumerableSet EnumerableMap".split()
TERMS = "dex amm pool router factory pair token erc20 erc721 erc1155 nft mint burn wallet account safe signature multisig aa dao govern vote vault stake yield beacon proxy uups upgradeable upgrade".split()
NAME_TOKENS = "factory router manager token vault proxy beacon registry pool pair sale market bridge oracle staking govern wallet swap dex nft airdrop launch lottery crowd locker escrow".split()
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def joined_text(files: Column) -> Column:
    return F.array_join(F.transform(files, lambda f: f["content"]), "\n")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def counts(text: Column) -> dict[str, Column]:
    return {k: count(text, p) for k, p in COUNTS.items()}


#: Whole words that features ask for: as they are written, and in lower case.
WRITTEN = {"import", "public", "external", "Ownable", "AccessControl", "onlyOwner", *LIBRARIES}
WRITTEN_FLAGS = {"has_ownable": "Ownable", "has_access_control": "AccessControl", "has_only_owner": "onlyOwner"}


def _of(found: Column, word: str) -> Column:
    return F.coalesce(F.try_element_at(found, F.lit(word)), F.lit(0.0))


def with_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the 92 features. Words are counted in two passes over each text, kept as maps, and declared names are read once; only patterns of several words have a pass
    of their own."""
    t = F.col(text)
    hits = lambda c, words: F.regexp_extract_all(c, F.lit(rf"\b(?:{'|'.join(sorted(words))})\b"), F.lit(0))
    once = rows.withColumns({"_written": hits(t, WRITTEN), "_terms": hits(F.lower(t), TERMS), "_names": declared_names(t)})
    tally = lambda c: F.map_from_entries(F.transform(F.array_distinct(c), lambda w: F.struct(w, F.size(F.filter(c, lambda x: x == w)).cast("double"))))
    once = once.withColumns({"_written": tally(F.col("_written")), "_terms": tally(F.col("_terms"))})
    w, terms = F.col("_written"), F.col("_terms")
    both = F.greatest(_of(w, "public") + _of(w, "external"), F.lit(1.0))
    found = {k: count(t, p) for k, p in COUNTS.items() if k not in ("n_imports", "n_contracts")} | {"n_imports": _of(w, "import"), "n_contracts": F.size("_names").cast("double")}
    found |= sizes(t) | {k: F.rlike(t, F.lit(p)).cast("double") for k, p in FLAGS.items() if k not in WRITTEN_FLAGS} | {k: (_of(w, x) > 0).cast("double") for k, x in WRITTEN_FLAGS.items()}
    found |= {"public_ratio": _of(w, "public") / both, "external_ratio": _of(w, "external") / both}
    found |= {k: c for k, c in libraries(t).items() if not k.startswith("lib_")} | {f"lib_{x}": (_of(w, x) > 0).cast("double") for x in LIBRARIES}
    found |= {f"bow_{x}": _of(terms, x) for x in TERMS} | tokens_in(F.col("_names"))
    return once.withColumns(dict(sorted(found.items()))).drop("_written", "_terms", "_names")


def feature_names() -> list[str]:
    return list(all_features(F.lit("")))


def sizes(text: Column) -> dict[str, Column]:
    """Lines, a trailing empty one not counted, and code points."""
    lines = F.regexp_count(text, F.lit(LINE_END)) + F.when(F.rlike(text, F.lit(rf"(?:{LINE_END})\z")), 0).otherwise(1)
    return {"n_lines": F.when(text == "", 0).otherwise(lines).cast("double"), "n_chars": F.length(text).cast("double")}


def flags(text: Column) -> dict[str, Column]:
    return {k: F.rlike(text, F.lit(p)).cast("double") for k, p in FLAGS.items()}


def ratios(text: Column) -> dict[str, Column]:
    public, external = count(text, r"\bpublic\b"), count(text, r"\bexternal\b")
    both = F.greatest(public + external, F.lit(1.0))
    return {"public_ratio": public / both, "external_ratio": external / both}


def libraries(text: Column) -> dict[str, Column]:
    used = F.regexp_extract_all(text, F.lit(USING), F.lit(1))
    out = {"n_using": F.size(used).cast("double"), "n_library_decl": count(text, LIBRARY), "n_distinct_using": F.size(F.array_distinct(used)).cast("double")}
    return out | {f"lib_{x}": F.rlike(text, F.lit(rf"\b{x}\b")).cast("double") for x in LIBRARIES}


def bag_of_words(text: Column) -> dict[str, Column]:
    """Counts of words of two letters or more that are exactly a term, in lower case."""
    lower = F.lower(text)
    return {f"bow_{t}": count(lower, rf"\b{t}\b") for t in TERMS}


def name_tokens(text: Column) -> dict[str, Column]:
    """In how many declared contract names, in lower case, each token is."""
    return tokens_in(declared_names(text))


def declared_names(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(COUNTS["n_contracts"]), F.lit(1)), lambda n: F.lower(n))


def tokens_in(names: Column) -> dict[str, Column]:
    holds = lambda t: lambda n: F.contains(n, F.lit(t))
    return {f"name_{t}": F.size(F.filter(names, holds(t))).cast("double") for t in NAME_TOKENS}


def all_features(text: Column) -> dict[str, Column]:
    """The 92 features, by name in sorted order."""
    found = counts(text) | sizes(text) | flags(text) | ratios(text) | libraries(text) | bag_of_words(text) | name_tokens(text)
    return dict(sorted(found.items()))
