"""Opcodes, and expressions over hex text of contract code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of opcodes by their first byte; PUSH, DUP and SWAP follow from a rule.
_NAMED = {
    "00": "STOP ADD MUL SUB DIV SDIV MOD SMOD ADDMOD MULMOD EXP SIGNEXTEND",
    "10": "LT GT SLT SGT EQ ISZERO AND OR XOR NOT BYTE SHL SHR SAR",
    "20": "SHA3",
    "30": "ADDRESS BALANCE ORIGIN CALLER CALLVALUE CALLDATALOAD CALLDATASIZE CALLDATACOPY CODESIZE CODECOPY GASPRICE EXTCODESIZE EXTCODECOPY RETURNDATASIZE RETURNDATACOPY EXTCODEHASH",
    "40": "BLOCKHASH COINBASE TIMESTAMP NUMBER DIFFICULTY GASLIMIT CHAINID SELFBALANCE",
    "50": "POP MLOAD MSTORE MSTORE8 SLOAD SSTORE JUMP JUMPI PC MSIZE GAS JUMPDEST",
    "a0": "LOG0 LOG1 LOG2 LOG3 LOG4",
    "f0": "CREATE CALL CALLCODE RETURN DELEGATECALL CREATE2",
    "fa": "STATICCALL",
    "fd": "REVERT INVALID SELFDESTRUCT",
}
OPCODES = {f"{int(at, 16) + k:02x}": name for at, names in _NAMED.items() for k, name in enumerate(names.split())}
OPCODES |= {f"{base + k:02x}": f"{name}{k + 1}" for base, name, n in ((0x60, "PUSH", 32), (0x80, "DUP", 16), (0x90, "SWAP", 16)) for k in range(n)}

JUMP, JUMPI, JUMPDEST, CREATE, CREATE2 = "56", "57", "5b", "f0", "f5"
#: Opcodes after which a block starts; those that do not fall through; those after which a block's creations no longer count.
ENDS_BLOCK = [JUMP, JUMPI, "f3", "fd", "00", "ff", "fe"]
BREAKS = [JUMP, "f3", "fd", "00", "ff"]
STOPS = ["fe", "fd", "f3", "00", "ff"]
#: One instruction: a PUSH with what is there of its operand, or one byte.
INSTRUCTION = "|".join(f"{0x5F + n:02x}.{{0,{2 * n}}}" for n in range(1, 33)) + "|.."


def strip_0x(code: Column) -> Column:
    """Without a lower-case 0x prefix."""
    return F.when(code.startswith("0x"), F.substring(code, 3, 1 << 30)).otherwise(code)


def instructions(code: Column) -> Column:
    """The instructions' hex texts, in order."""
    return F.regexp_extract_all(F.lower(strip_0x(code)), F.lit(f"({INSTRUCTION})"), F.lit(1))


def byte_positions(code: Column, *bytes_: str) -> Column:
    """Byte offsets at which one of the bytes stands, operands and data included."""
    hexed = F.lower(strip_0x(code))
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))
    return F.filter(F.transform(pairs, lambda b, i: F.when(b.isin(*bytes_), i.cast("int"))), lambda x: x.isNotNull())


def naive_count(code: Column, byte: str) -> Column:
    """Occurrences of the two digits anywhere, not only at byte offsets."""
    return ((F.length(code) - F.length(F.replace(code, F.lit(byte), F.lit("")))) / 2).cast("bigint")


def bytecode_hash(code: Column) -> Column:
    """SHA-256 of the text as it is; a null code hashes as the word None."""
    return F.sha2(F.coalesce(code, F.lit("None")), 256)


def opcode_name(op: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in OPCODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, op), F.concat(F.lit("UNKNOWN_"), op))


def operand_size(op: Column) -> Column:
    value = F.conv(op, 16, 10).cast("int")
    return F.when(op.between("60", "7f"), value - 0x5F).otherwise(0)
