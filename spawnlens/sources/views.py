"""Deterministic views of blockchain tables over the driver's tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes by key: what a code of key k begins with, so that both detectors have something to tell apart.
HEADS = ["", "0x", "6006565bf0005b", "f0fd", "57f0", "600656fe5bf500", "60035760065bf5", "f06000ff"]
#: Customers whose contracts share a code, so that a code has some 40 contracts, and different codes of the evaluated contracts.
CUSTOMERS, N_CODES = 4, 97


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(*parts) -> F.Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _code(k) -> F.Column:
    """The code of key k. Its text stands once in the expression and is never null unless k is, so that a look for null codes makes no code."""
    heads = F.array(*[F.lit(h) for h in HEADS])
    head = F.element_at(heads, (k % 8 + 1).cast("int"))
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 24), lambda i: F.sha2(F.concat(F.lit("code-"), k.cast("string"), F.lit("-"), i.cast("string")), 256)), "")
    size = F.length(head) + 64 * (k % 24 + 1).cast("int") - (k % 5 == 3).cast("int")
    cut = F.substring(F.concat(head, body), F.lit(1), size)
    code = F.when(k % 11 == 4, F.concat(F.lit("0x"), F.upper(F.replace(cut, F.lit("0x"), F.lit(""))))).otherwise(cut)
    return F.when(k.isNotNull(), F.coalesce(code, F.lit("")))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        F.when(k % 2 == 0, "ethereum").otherwise("polygon").alias("chain"),
        F.concat(F.lit("0x"), F.upper(F.substring(_sha("a", k), 1, 40))).alias("address"),
        F.when(k % 53 == 0, F.lit(None)).when(k % 59 == 0, F.lit("0x")).otherwise(_code(F.floor(F.col("o_custkey") / CUSTOMERS))).alias("code"),
        F.col("o_orderdate").cast("timestamp").alias("block_timestamp"),
        k.alias("block_number"),
        F.concat(F.lit("0x"), _sha("t", k)).alias("transaction_hash"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return _read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 2 == 0, "ethereum").otherwise("polygon").alias("chain"),
        F.when(F.col("l_returnflag") == "R", "call").otherwise("create").alias("trace_type"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("bigint").alias("status"),
        F.when(F.col("l_suppkey") % 41 == 0, F.lit("0x" + "0" * 40)).otherwise(F.concat(F.lit("0x"), F.upper(F.substring(_sha("f", F.col("l_suppkey")), 1, 40)))).alias("from_address"),
        F.when(n == 7, F.lit(None)).otherwise(F.concat(F.lit("0x"), F.upper(F.substring(_sha("c", F.col("l_orderkey"), "-", n), 1, 40)))).alias("to_address"),
        F.concat(F.lit("0x"), _sha("t", F.col("l_orderkey"))).alias("transaction_hash"),
        F.col("l_orderkey").alias("block_number"),
        F.col("l_shipdate").cast("timestamp").alias("block_timestamp"),
        F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.lit("0")).when(n % 4 == 2, F.lit("0,1")).alias("trace_address"),
        F.when(F.col("l_partkey") % 13 == 0, F.lit("x")).when(F.col("l_partkey") % 17 == 0, F.lit("9" * 30)).otherwise((F.col("l_partkey") * 1000000007).cast("string")).alias("value"),
        F.concat(F.lit("0x"), F.substring(_sha("i", F.col("l_partkey") % 101), 1, 16)).alias("input"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("0x"), F.substring(_sha("r", F.col("l_partkey") % 97), 1, 16))).alias("output"),
        F.col("l_quantity").cast("bigint").alias("gas"),
        (F.col("l_quantity") / 2).cast("bigint").alias("gas_used"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("0x"), _sha("t", k)).alias("hash"),
        F.when(k % 7 == 0, F.lit("0x")).otherwise(_code(F.floor(F.col("o_custkey") / CUSTOMERS))).alias("input"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit(None)).when(F.col("o_orderpriority").startswith("2"), F.lit(None)).otherwise(F.concat(F.lit("0x"), F.substring(_sha("to", k), 1, 40))).alias("to_address"),
        F.col("o_orderdate").cast("timestamp").alias("block_timestamp"),
        k.alias("block_number"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("0x"), _sha("t", k)).alias("transaction_hash"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("0x"), F.upper(F.substring(_sha("a", k), 1, 40)))).alias("contract_address"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).cast("bigint").alias("status"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated contracts: labels give truth and verdict, keys the rest."""
    d = F.col("doc_id")
    vanity = F.when(d % 10 == 0, F.concat(F.lit("0x000000000"), F.substring(_sha("v", d), 1, 31))).otherwise(F.concat(F.lit("0x"), F.substring(_sha("v", d), 1, 40)))
    names = F.array(*[F.lit(x) for x in ("PairFactory", "MintClub", "TokenSale", "SwapRouter", "Juniper")])
    notes = F.when(d % 3 == 0, F.concat(F.lit("Factory contract identified from traces: executed "), (d * d % 20011).cast("string"), F.lit(" CREATE operations"))).otherwise(F.concat(F.lit("Verified non-factory: no create/create2/new keywords. Contract: "), F.element_at(names, (d % 5 + 1).cast("int"))))
    types = F.array(*[F.lit(x) for x in ("CREATE_ONLY", "CREATE2_ONLY", "BOTH_CREATE_CREATE2", "NONE")])
    return _read(spark, sf_dir, "labels").select(
        vanity.alias("address"),
        _code(d % N_CODES).alias("bytecode"),
        (F.col("quality") == 1).alias("is_factory_ground_truth"),
        F.when(d % 29 == 0, F.lit(None)).otherwise(F.col("toxic") == 0).alias("is_factory_detected"),
        (d * 7 % 190).alias("execution_time"),
        F.when(d % 3 == 0, "traces").otherwise("etherscan").alias("source_type"),
        notes.alias("verification_notes"),
        F.element_at(types, (d % 4 + 1).cast("int")).alias("factory_type"),
        (d % 9 / 10.0).alias("confidence_score"),
        (d % 6).cast("int").alias("create_positions"),
        d.alias("id"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source packages, one row an address: files array<struct<path, content>>; ASCII only."""
    k, name = F.col("p_partkey"), F.initcap(F.col("p_name"))
    base = F.replace(name, F.lit(" "), F.lit(""))
    tails = F.array(*[F.lit(x) for x in ("Factory", "Router", "PairFactory", "TokenVault", "NFTMarket", "Registry")])
    cname = F.concat(base, F.element_at(tails, (k % 6 + 1).cast("int")))
    body = F.concat(
        F.when(k % 2 == 0, F.lit('import "openzeppelin/Ownable.sol";\n')).otherwise(F.lit("")),
        F.when(k % 7 == 0, F.lit("library Strings { }\n")).otherwise(F.lit("")),
        F.when(k % 9 == 0, F.lit("interface IPool { function swap(uint a) external; }\n")).otherwise(F.lit("")),
        F.when(k % 10 == 0, F.lit("abstract ")).otherwise(F.lit("")), F.lit("contract "), cname, F.when(k % 2 == 0, F.lit(" is Ownable")).otherwise(F.lit("")), F.lit(" {\n"),
        F.when(k % 3 == 0, F.lit("  using Clones for address;\n  using SafeMath for uint256;\n")).otherwise(F.lit("")),
        F.lit("  mapping(address => address[]) public pools;\n  event Made(address p);\n"),
        F.repeat(F.lit("  function f(uint x) public { }\n"), (F.col("p_size") % 5).cast("int")),
        F.when(k % 4 == 1, F.lit("  function make(bytes32 salt) external onlyOwner { create2(0, 0, 0, salt); }\n")).otherwise(F.lit("")),
        F.when(k % 5 == 1, F.lit("  function spawn() external { create(0, 0, 0); }\n  constructor() { }\n  modifier lock() { _; }\n")).otherwise(F.lit("")),
        F.when(k % 8 == 3, F.lit("  // uups proxy beacon factory token pool vault dao vote predictAddress( delegatecall AccessControl\n")).otherwise(F.lit("")), F.lit("}\n"),
    )
    return _read(spark, sf_dir, "part").select(
        F.when(k % 2 == 0, "ethereum").otherwise("polygon").alias("chain"),
        F.concat(F.lit("0x"), F.substring(_sha("s", k), 1, 40)).alias("address"),
        F.array(F.struct(F.concat(cname, F.lit(".sol")).alias("path"), F.when(k % 31 == 0, F.lit("")).otherwise(body).alias("content"))).alias("files"),
        k.alias("id"),
    )


def factory_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with creation counts as text, some of which are no numbers."""
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        F.when(k % 2 == 0, "ethereum").otherwise("polygon").alias("chain"),
        F.concat(F.lit("0x"), F.upper(F.substring(_sha("s", k), 1, 40))).alias("factory_address"),
        F.when(k % 19 == 0, F.lit("n/a")).otherwise((k * 37 % 1009).cast("string")).alias("total_creations"),
        F.when(k % 23 == 0, F.lit("")).otherwise((k * 17 % 11).cast("string")).alias("unique_creations"),
        k.alias("id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")


_HEADS = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"


def _sql_code(k: str) -> str:
    whole = f"({_HEADS}[CAST(({k}) % 8 + 1 AS INTEGER)] || array_to_string(list_transform(range(0, ({k}) % 24 + 1), lambda i: sha256('code-' || ({k}) || '-' || i)), ''))"
    cut = f"(CASE WHEN ({k}) % 5 = 3 THEN substr({whole}, 1, length({whole}) - 1) ELSE {whole} END)"
    return f"(CASE WHEN ({k}) % 11 = 4 THEN '0x' || upper(replace({cut}, '0x', '')) ELSE {cut} END)"


def _pick(xs: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + f"][CAST({k} + 1 AS INTEGER)]"


#: The same views for DuckDB; a query names those it needs.
SQL = {
    "contracts": f"""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ethereum' ELSE 'polygon' END AS chain, '0x' || upper(substr(sha256('a' || o_orderkey), 1, 40)) AS address,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN '0x' ELSE {_sql_code(f"o_custkey // {CUSTOMERS}")} END AS code, o_orderdate AS block_timestamp, o_orderkey AS block_number, '0x' || sha256('t' || o_orderkey) AS transaction_hash FROM orders""",
    "traces": f"""SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'ethereum' ELSE 'polygon' END AS chain, CASE WHEN l_returnflag = 'R' THEN 'call' ELSE 'create' END AS trace_type, CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS status,
  CASE WHEN l_suppkey % 41 = 0 THEN '0x{"0" * 40}' ELSE '0x' || upper(substr(sha256('f' || l_suppkey), 1, 40)) END AS from_address, CASE WHEN l_linenumber = 7 THEN NULL ELSE '0x' || upper(substr(sha256('c' || l_orderkey || '-' || l_linenumber), 1, 40)) END AS to_address,
  '0x' || sha256('t' || l_orderkey) AS transaction_hash, l_orderkey AS block_number, l_shipdate AS block_timestamp, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0,1' END AS trace_address,
  CASE WHEN l_partkey % 13 = 0 THEN 'x' WHEN l_partkey % 17 = 0 THEN '{"9" * 30}' ELSE CAST(l_partkey * 1000000007 AS VARCHAR) END AS value, '0x' || substr(sha256('i' || (l_partkey % 101)), 1, 16) AS input,
  CASE WHEN l_partkey % 11 = 0 THEN '' ELSE '0x' || substr(sha256('r' || (l_partkey % 97)), 1, 16) END AS output, CAST(floor(l_quantity) AS BIGINT) AS gas, CAST(floor(l_quantity / 2) AS BIGINT) AS gas_used FROM lineitem""",
    "transactions": f"""SELECT '0x' || sha256('t' || o_orderkey) AS hash, CASE WHEN o_orderkey % 7 = 0 THEN '0x' ELSE {_sql_code(f"o_custkey // {CUSTOMERS}")} END AS input,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN NULL ELSE '0x' || substr(sha256('to' || o_orderkey), 1, 40) END AS to_address, o_orderdate AS block_timestamp, o_orderkey AS block_number FROM orders""",
    "receipts": "SELECT '0x' || sha256('t' || o_orderkey) AS transaction_hash, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '0x' || upper(substr(sha256('a' || o_orderkey), 1, 40)) END AS contract_address, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS BIGINT) AS status FROM orders",
    "ground_truth": f"""SELECT CASE WHEN doc_id % 10 = 0 THEN '0x000000000' || substr(sha256('v' || doc_id), 1, 31) ELSE '0x' || substr(sha256('v' || doc_id), 1, 40) END AS address, {_sql_code(f"doc_id % {N_CODES}")} AS bytecode, quality = 1 AS is_factory_ground_truth,
  CASE WHEN doc_id % 29 = 0 THEN NULL ELSE toxic = 0 END AS is_factory_detected, doc_id * 7 % 190 AS execution_time, CASE WHEN doc_id % 3 = 0 THEN 'traces' ELSE 'etherscan' END AS source_type,
  CASE WHEN doc_id % 3 = 0 THEN 'Factory contract identified from traces: executed ' || (doc_id * doc_id % 20011) || ' CREATE operations' ELSE 'Verified non-factory: no create/create2/new keywords. Contract: ' || {_pick(["PairFactory", "MintClub", "TokenSale", "SwapRouter", "Juniper"], "doc_id % 5")} END AS verification_notes,
  {_pick(["CREATE_ONLY", "CREATE2_ONLY", "BOTH_CREATE_CREATE2", "NONE"], "doc_id % 4")} AS factory_type, (doc_id % 9) / 10.0 AS confidence_score, CAST(doc_id % 6 AS INTEGER) AS create_positions, doc_id AS id FROM labels""",
    "sources": f"""SELECT chain, address, CASE WHEN id % 31 = 0 THEN '' ELSE body END AS content, path, id FROM (SELECT *, cname || '.sol' AS path, CASE WHEN id % 2 = 0 THEN 'import "openzeppelin/Ownable.sol";' || chr(10) ELSE '' END || CASE WHEN id % 7 = 0 THEN 'library Strings {{ }}' || chr(10) ELSE '' END
  || CASE WHEN id % 9 = 0 THEN 'interface IPool {{ function swap(uint a) external; }}' || chr(10) ELSE '' END || CASE WHEN id % 10 = 0 THEN 'abstract ' ELSE '' END || 'contract ' || cname || CASE WHEN id % 2 = 0 THEN ' is Ownable' ELSE '' END || ' {{' || chr(10)
  || CASE WHEN id % 3 = 0 THEN '  using Clones for address;' || chr(10) || '  using SafeMath for uint256;' || chr(10) ELSE '' END || '  mapping(address => address[]) public pools;' || chr(10) || '  event Made(address p);' || chr(10) || repeat('  function f(uint x) public {{ }}' || chr(10), p_size % 5)
  || CASE WHEN id % 4 = 1 THEN '  function make(bytes32 salt) external onlyOwner {{ create2(0, 0, 0, salt); }}' || chr(10) ELSE '' END || CASE WHEN id % 5 = 1 THEN '  function spawn() external {{ create(0, 0, 0); }}' || chr(10) || '  constructor() {{ }}' || chr(10) || '  modifier lock() {{ _; }}' || chr(10) ELSE '' END
  || CASE WHEN id % 8 = 3 THEN '  // uups proxy beacon factory token pool vault dao vote predictAddress( delegatecall AccessControl' || chr(10) ELSE '' END || '}}' || chr(10) AS body FROM (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ethereum' ELSE 'polygon' END AS chain, '0x' || substr(sha256('s' || p_partkey), 1, 40) AS address, p_partkey AS id, p_size,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), '') || {_pick(["Factory", "Router", "PairFactory", "TokenVault", "NFTMarket", "Registry"], "p_partkey % 6")} AS cname FROM part))""".replace("{{", "{").replace("}}", "}"),
    "factory_addresses": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ethereum' ELSE 'polygon' END AS chain, '0x' || upper(substr(sha256('s' || p_partkey), 1, 40)) AS factory_address, CASE WHEN p_partkey % 19 = 0 THEN 'n/a' ELSE CAST(p_partkey * 37 % 1009 AS VARCHAR) END AS total_creations, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE CAST(p_partkey * 17 % 11 AS VARCHAR) END AS unique_creations, p_partkey AS id FROM part",
    "vectors": "SELECT vec_id AS id, CAST(label AS INTEGER) AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings",
}


def sql(text: str, *names: str) -> str:
    """text with the named views as common table expressions v_<name>."""
    head = ", ".join(f"v_{n} AS ({SQL[n]})" for n in names)
    if not head:
        return text
    body = text.strip()
    return f"WITH RECURSIVE {head}, {body[4:].lstrip().removeprefix('RECURSIVE')}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
