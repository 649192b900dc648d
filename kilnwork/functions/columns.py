"""Column functions: hashes, strings, dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE32 = "0123456789abcdfghijklmnpqrsvwxyz"


def path_key(col: Column) -> Column:
    return F.sha2(col, 256)


def path_fingerprint(path: Column, hash_: Column, size: Column, refs: Column) -> Column:
    """``1;path;hash;size;refs`` with the references sorted and joined by commas."""
    return F.concat_ws(";", F.lit("1"), path, hash_, size.cast("string"), F.array_join(F.array_sort(refs), ","))


def base32(hex_text: Column, n_bytes: int) -> Column:
    """Base-32 text of bytes given in hex: 5-bit groups, the highest first, from the little-endian bit string."""
    byte = lambda i: F.conv(F.substring(hex_text, 2 * i + 1, 2), 16, 10).cast("int")
    out = []
    for n in range((n_bytes * 8 - 1) // 5, -1, -1):
        i, shift = divmod(n * 5, 8)
        high = F.shiftleft(byte(i + 1), 8 - shift) if i + 1 < n_bytes else F.lit(0)
        digit = F.shiftright(byte(i), shift).bitwiseOR(high).bitwiseAND(31)
        out.append(F.substr(F.lit(BASE32), digit + 1, F.lit(1)))
    return F.concat(*out)


def fold_hex(hex_text: Column, n_bytes: int) -> Column:
    """XOR of the bytes at equal places modulo ``n_bytes``, in lower-case hex; for digests of 32 bytes."""
    byte = lambda i: F.conv(F.substring(hex_text, 2 * i + 1, 2), 16, 10).cast("int")
    parts = []
    for i in range(n_bytes):
        value = byte(i)
        for j in range(i + n_bytes, 32, n_bytes):
            value = value.bitwiseXOR(byte(j))
        parts.append(F.lpad(F.lower(F.hex(value.cast("long"))), 2, "0"))
    return F.concat(*parts)


def content_path(name: Column, kind: Column, digest: Column, refs: Column, store: str = "/store") -> Column:
    """Path of fixed content: the folded sha256 of a fingerprint of kind, references, digest, store and name."""
    kinds = F.array_join(F.concat(F.array(kind), F.array_sort(refs)), ":")
    print_ = F.concat_ws(":", kinds, F.lit("sha256"), digest, F.lit(store), name)
    return F.concat(F.lit(f"{store}/"), base32(fold_hex(F.sha2(print_, 256), 20), 20), F.lit("-"), name)


def digest(col: Column, algo: str) -> Column:
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[algo](col)


def format_digest(hex_text: Column, algo: str, form: str) -> Column:
    """hex, ``algo:hex`` ('typed') or ``algo-base64`` ('sri')."""
    return {
        "hex": lambda: hex_text,
        "typed": lambda: F.concat(F.lit(f"{algo}:"), hex_text),
        "sri": lambda: F.concat(F.lit(f"{algo}-"), F.base64(F.unhex(hex_text))),
    }[form]()


def basename(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def hash_prefix(col: Column, n: int = 8) -> Column:
    return F.substring(basename(col), 1, n)


def is_drv(col: Column) -> Column:
    return F.endswith(col, F.lit(".drv"))


def human_bytes(col: Column, units: Sequence[str] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """Whole bytes below a KiB, else one decimal (halves to even) and the largest fitting of ``units``; the last one has no end."""
    shown = lambda i, unit: F.concat(F.format_string("%.1f", F.bround(col / 1024**i, 1)), F.lit(f" {unit}"))
    out = F.when(col < 1024, F.concat(col.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(units[:-1], start=1):
        out = out.when(col < 1024 ** (i + 1), shown(i, unit))
    return out.otherwise(shown(len(units), units[-1]))


def strip_ansi(msg: Column) -> Column:
    return F.regexp_replace(msg, "\x1b\\[[0-9;]*[A-Za-z]", "")


def is_input_failure(status: Column, msg: Column, paths: Column, marker: str = "failed to build input") -> Column:
    """A failure whose message, without colour codes, has the marker and one of the known paths."""
    plain = strip_ansi(msg)
    return F.coalesce((status == "failed") & F.contains(plain, F.lit(marker)) & F.exists(paths, lambda p: F.contains(plain, p)), F.lit(False))


def parse_cpu_millis(col: Column) -> Column:
    """Thousandths of a core from ``64``, ``1.5``, ``1e3`` or ``136000m``, to the nearest one; anything else is 0.

    Before ``m`` only a whole number counts; nothing is trimmed, and a negative
    number is 0.
    """
    milli = F.regexp_extract(col, r"^\+?([0-9]+)m$", 1).try_cast("bigint")
    cores = F.when(col.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), col.try_cast("double"))
    return F.coalesce(milli, F.greatest(F.round(cores * 1000), F.lit(0.0)).cast("long"), F.lit(0).cast("long"))


def epoch_micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def age_secs(col: Column, as_of: Column) -> Column:
    return (epoch_micros(as_of) - epoch_micros(col)) / 1e6


def hours_before(as_of: Column, hours: Column) -> Column:
    """``as_of`` less a number of hours from a column."""
    return as_of - F.make_dt_interval(F.lit(0), hours.cast("int"), F.lit(0), F.lit(0))


STEP_BYTES, STEP_MILLIS = 4 << 30, 2000


def resource_bucket(df: DataFrame, headroom: float = 1.25) -> DataFrame:
    """Add ``mem_bucket`` and ``cpu_bucket``: estimates with headroom up to whole steps, one at least.

    Memory that is null or not finite has no bucket; cpu counts as one core then.
    """
    mem, cpu = F.col("ema_peak_memory_bytes"), F.coalesce("ema_peak_cpu_cores", F.lit(1.0))
    finite = mem.isNotNull() & ~F.isnan(mem) & (F.abs(mem) < float("inf"))
    steps = lambda x, step: F.greatest(F.ceil(x * headroom / step), F.lit(1)) * step
    return df.withColumns({"mem_bucket": F.when(finite, steps(mem, STEP_BYTES)), "cpu_bucket": steps(cpu * 1000, STEP_MILLIS)})


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def sat_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def append_once(a: Column, x: Column) -> Column:
    return F.array_union(a, F.array(x))


def map_get(m: Column, key: Column, default=0) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def parse_options(col: Column) -> Column:
    """Options of a build: keep_going, timeout_secs and cores, with defaults where absent or not JSON."""
    read = F.from_json(col, "keep_going boolean, timeout_secs long, cores long, k long")
    return F.struct(
        F.coalesce(read["keep_going"], F.lit(False)).alias("keep_going"),
        F.coalesce(read["timeout_secs"], F.lit(0)).alias("timeout_secs"),
        F.coalesce(read["cores"], F.lit(1)).alias("cores"),
        F.coalesce(read["k"], F.lit(0)).alias("k"),
    )


def class_rank(col: Column, order: Sequence[str]) -> Column:
    """Place of a class from 0; an unknown or null one is -1."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), col), F.lit(0)).cast("int") - 1


def max_class(a: Column, b: Column, order: Sequence[str]) -> Column:
    return F.when(class_rank(a, order) >= class_rank(b, order), a).otherwise(b)


def next_class(a: Column, order: Sequence[str]) -> Column:
    """The next larger class, the last one for itself, null for an unknown one."""
    rank = class_rank(a, order)
    return F.when(rank >= 0, F.get(F.array(*[F.lit(c) for c in order]), F.least(rank + 1, F.lit(len(order) - 1))))
