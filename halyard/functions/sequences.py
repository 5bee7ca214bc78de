"""Token sequences as array columns. Ids: pad 0, bos 1, eos 2, pocket 3 .. 4, ligand 5 .. 6; codes follow from 7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions import scalars

PAD, BOS, EOS, POCKET, POCKET_END, LIGAND, LIGAND_END, FIRST_CODE = range(8)
IGNORED_LABEL, IGNORED_LOSS, PAD_SEGMENT = 255, -100, -1


def _ids(*ids: int) -> Column:
    return F.array(*(F.lit(i) for i in ids))


def _codes(codes: Column, offset: int = FIRST_CODE) -> Column:
    return F.transform(F.coalesce(codes, F.array().cast("array<int>")), lambda c: (c + offset).cast("int"))


def build_sequence(pocket: Column, ligand: Column) -> Column:
    """bos <p> pocket </p> <l> ligand </l> eos; either block may be empty or null."""
    return F.concat(_ids(BOS, POCKET), _codes(pocket), _ids(POCKET_END, LIGAND), _codes(ligand), _ids(LIGAND_END, EOS))


def block(tokens: Column, start: int, end: int) -> Column:
    """Codes between the first start mark and the first end mark after it; empty without both."""
    a = F.array_position(tokens, start)
    rest = F.slice(tokens, F.greatest(a, F.lit(1)).cast("int"), F.size(tokens))
    b = F.array_position(rest, end)
    inner = F.slice(rest, 2, F.greatest(b - 2, F.lit(0)).cast("int"))
    return F.when((a > 0) & (b > 0), F.transform(F.filter(inner, lambda t: t >= FIRST_CODE), lambda t: t - FIRST_CODE)).otherwise(F.array().cast("array<int>"))


def split_sequence(tokens: Column) -> tuple[Column, Column]:
    return block(tokens, POCKET, POCKET_END), block(tokens, LIGAND, LIGAND_END)


def ranged_sequence(parts: list[tuple[Column, int, int | None]]) -> Column:
    """Blocks of disjoint id ranges: (ids, offset, required length). A block of another length fails the row."""
    out = [_ids(BOS)]
    for ids, offset, length in parts:
        if length is not None:
            ids = F.when(F.size(ids) == length, ids).otherwise(F.raise_error(F.lit(f"a block must have {length} ids")).cast("array<int>"))
        out.append(_codes(ids, offset))
    return F.concat(*out, _ids(EOS))


def split_ranges(tokens: Column, bounds: list[tuple[int, int, int | None]]) -> list[Column]:
    """The inverse: ids of each [low, high) less low; null where a required length is missed."""

    def own(low: int, high: int) -> Column:
        return F.transform(F.filter(tokens, lambda t: (t >= low) & (t < high)), lambda t: t - low)

    return [own(low, high) if length is None else F.when(F.size(own(low, high)) == length, own(low, high)) for low, high, length in bounds]


def ligand_mask(tokens: Column) -> Column:
    """Whether each token is a code between the first <l> and the last </l>."""
    a = F.array_position(tokens, LIGAND)
    b = F.size(tokens) + 1 - F.array_position(F.reverse(tokens), LIGAND_END)
    there = F.array_contains(tokens, LIGAND) & F.array_contains(tokens, LIGAND_END)
    return F.transform(tokens, lambda t, i: there & (t >= FIRST_CODE) & (i + 1 > a) & (i + 1 < b))


def prompt_labels(tokens: Column) -> Column:
    """Labels of a causal model: what stands up to the first <l> bears no loss, nor does anything without one."""
    a = F.array_position(tokens, LIGAND)
    return F.transform(tokens, lambda t, i: F.when((a > 0) & (i + 1 > a) & (i > 0), t).otherwise(F.lit(IGNORED_LOSS)))


def pad_right(tokens: Column, to: Column, value: int = PAD) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(value), F.greatest(to - F.size(tokens), F.lit(0)).cast("int")))


def attention_mask(tokens: Column, to: Column) -> Column:
    return F.concat(F.transform(tokens, lambda t: F.lit(1)), F.array_repeat(F.lit(0), F.greatest(to - F.size(tokens), F.lit(0)).cast("int")))


def truncate(tokens: Column, block_size: int) -> Column:
    return F.slice(tokens, 1, block_size)


def drop_pocket(tokens: Column, drop: Column) -> Column:
    """The pocket's codes gone where drop holds; its marks stay."""
    a, b = F.array_position(tokens, POCKET), F.array_position(tokens, POCKET_END)
    short = F.concat(F.slice(tokens, 1, F.greatest(a, F.lit(1)).cast("int")), F.slice(tokens, F.greatest(b, F.lit(1)).cast("int"), F.size(tokens)))
    return F.when(drop & (a > 0) & (b > a), short).otherwise(tokens)


def token_labels(labels: Column, pocket_size: Column, ligand_size: Column) -> Column:
    """Labels of ligand atoms at their tokens of a built sequence; a wrong number of labels fails the row."""
    checked = F.when(F.size(labels) == ligand_size, labels).otherwise(F.raise_error(F.lit("labels and ligand codes differ in number")).cast("array<int>"))
    return F.concat(F.array_repeat(F.lit(IGNORED_LABEL), (pocket_size + 4).cast("int")), checked, _ids(IGNORED_LABEL, IGNORED_LABEL))


def masked(tokens: Column, maskable: Column, share: float, mask_id: int, vocab: int, seed: int, key: Column) -> tuple[Column, Column]:
    """(inputs, labels) of masked prediction: round(share * n), one at least, of the maskable tokens in the order of their hashes;
    of those 8 in 10 become the mask, 1 in 10 another code, 1 stays."""
    hashes = F.transform(tokens, lambda t, i: F.xxhash64(F.lit(seed), key, i))
    wanted = F.greatest(F.lit(1), F.bround(F.size(F.filter(maskable, lambda m: m)) * F.lit(share)).cast("int"))
    own = F.array_sort(F.filter(F.zip_with(hashes, maskable, lambda h, m: F.when(m, h)), lambda h: h.isNotNull()))
    last = F.get(own, F.least(wanted, F.size(own)) - 1)
    chosen = F.zip_with(hashes, maskable, lambda h, m: m & (h <= last))
    lot = F.transform(hashes, lambda h: F.pmod(F.xxhash64(h), F.lit(10)))
    swap = F.transform(hashes, lambda h: (FIRST_CODE + F.pmod(F.xxhash64(h, F.lit(1)), F.lit(vocab))).cast("int"))
    pick = F.arrays_zip(tokens.alias("t"), chosen.alias("c"), lot.alias("l"), swap.alias("s"))
    inputs = F.transform(pick, lambda p: F.when(~F.coalesce(p["c"], F.lit(False)), p["t"]).when(p["l"] < 8, F.lit(mask_id)).when(p["l"] == 8, p["s"]).otherwise(p["t"]))
    labels = F.transform(pick, lambda p: F.when(F.coalesce(p["c"], F.lit(False)), p["t"]).otherwise(F.lit(IGNORED_LOSS)))
    return inputs, labels


def tokens_to_ids(tokens: Column, vocabulary: Column) -> Column:
    """Ids of a map column; null where any token is missing from it."""
    ids = F.transform(tokens, lambda t: F.element_at(vocabulary, t))
    return F.when(~F.exists(ids, lambda i: i.isNull()), ids)


def anchor_weights(tokens: Column, first: int, weight: float) -> Column:
    """weight on the first codes after <l>, 1 elsewhere."""
    a = F.array_position(tokens, LIGAND)
    return F.transform(tokens, lambda t, i: F.when((a > 0) & (i >= a) & (i < a + first), F.lit(weight)).otherwise(F.lit(1.0)))


def normalise(values: Column, mean: Column, std: Column) -> Column:
    return F.transform(F.arrays_zip(values.alias("v"), mean.alias("m"), std.alias("s")), lambda p: (p["v"] - p["m"]) / p["s"])


def softmax_share(x: Column, group_max: Column, group_sum: Column) -> Column:
    return F.exp(x - group_max) / group_sum


def resampled(codes: Column, share: float, vocab: int, seed: int, key: Column) -> Column:
    """codes with round(share * n) of them drawn anew from [0, vocab): the positions are the first in the order of their hashes, so exactly
    so many and the same on every run. A code may be drawn again as it was."""
    at = lambda salt, i: scalars.named_seed(seed + salt, F.concat_ws(":", key.cast("string"), i.cast("string")))
    order = F.array_sort(F.transform(codes, lambda c, i: F.struct(at(0, i).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, F.bround(F.size(codes) * F.lit(share)).cast("int")), lambda x: x["i"])
    return F.transform(codes, lambda c, i: F.when(F.array_contains(chosen, i), (at(1, i) % vocab).cast("int")).otherwise(c))
