"""Which accounts were known at training time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schema as S
from tidewatch.plans.ordering import lookup
from tidewatch.session import materialize

#: A filter has blocks of 512 bits. An account sets seven bits of one block, so a look at one row tells.
WORDS, PROBES = 8, 7
#: Blocks for the accounts of one block at about ten bits each, and at most so many: 8 MB, which may be broadcast. With more accounts
#: the filter lets more rows pass, and the exact join decides about those.
ACCOUNTS_PER_BLOCK, MOST_BLOCKS = 48, 1 << 17

SUBGROUPS = ("standard_out_of_time", "both_parties_seen", "unseen_entity")


def known_accounts(train: DataFrame) -> DataFrame:
    """Distinct accounts on either side of the training transactions, from one pass; a hot account is one row of each task by the shuffle."""
    return train.select(F.explode(F.array(S.SENDER, S.RECEIVER)).alias("account")).distinct()


def flag_unseen(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Append sender_seen, receiver_seen, both_seen and unseen_entity.

    Two left equi-joins with one row per account on the right. Spark broadcasts
    the account table only if its measured size allows, otherwise AQE splits
    the partitions of hot accounts on the left.
    """
    for side, flag in ((S.SENDER, "sender_seen"), (S.RECEIVER, "receiver_seen")):
        marked = accounts.select(F.col("account").alias(side), F.lit(True).alias(flag))
        df = lookup(df, marked, [side]).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    both = F.col("sender_seen") & F.col("receiver_seen")
    return df.withColumns({"both_seen": both, "unseen_entity": ~both})


def _block(account: Column, blocks: Column | int) -> Column:
    blocks = F.lit(blocks) if isinstance(blocks, int) else blocks
    return F.xxhash64(F.lit("block"), account).bitwiseAND(blocks.cast("long") - 1)


def _places(account: Column) -> Column:
    """Bits an account sets in its block: seven times nine bits of a hash."""
    drawn = F.xxhash64(account)
    return F.array(*[F.shiftright(drawn, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)])


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def account_filter(accounts: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``block, words, blocks``: a blocked Bloom filter of the column ``account``, built by an aggregate of bitwise ors."""
    blocks, held = 1, accounts.count()
    while blocks * ACCOUNTS_PER_BLOCK < held and blocks < most_blocks:
        blocks *= 2
    account = F.col("account").cast("string")
    places = accounts.select(_block(account, blocks).alias("block"), F.explode(_places(account)).alias("place"))
    words = places.groupBy("block", F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("bits"))
    filled = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    each = F.array(*[F.coalesce(F.try_element_at("held", F.lit(w)), F.lit(0).cast("long")) for w in range(WORDS)])
    return filled.select("block", each.alias("words"), F.lit(blocks).cast("long").alias("blocks"))


def may_hold(df: DataFrame, filtered: DataFrame, column: str, output: str) -> DataFrame:
    """Append whether an account may be among those of a filter; false is certain.

    The filter is broadcast, for its size is bounded, so no row moves.
    """
    size = filtered.agg(F.max("blocks")).first()[0]
    if size is None:
        return df.withColumn(output, F.lit(False))
    account = F.col(column).cast("string")
    words = filtered.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
    joined = df.withColumn("__at", _block(account, int(size))).join(F.broadcast(words), F.col("__at") == F.col("__block"), "left")
    places = _places(account)
    held = F.forall(places, lambda p: F.get(F.col("__words"), F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0)
    return joined.withColumn(output, F.coalesce(held, F.lit(False))).drop("__at", "__block", "__words")


def flag_unseen_filtered(df: DataFrame, accounts: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``flag_unseen`` with a filter first: only rows whose accounts the filter lets pass are joined with the accounts."""
    accounts = materialize(accounts, "known-accounts")
    filtered = materialize(account_filter(accounts, most_blocks), "account-filter")
    for side, flag in ((S.SENDER, "sender_seen"), (S.RECEIVER, "receiver_seen")):
        marked = may_hold(df, filtered, side, flag)
        known = accounts.select(F.col("account").alias(side), F.lit(True).alias("__known"))
        passed = lookup(marked.where(flag), known, [side]).withColumn(flag, F.coalesce("__known", F.lit(False))).drop("__known")
        df = passed.unionByName(marked.where(~F.col(flag)))
    both = F.col("sender_seen") & F.col("receiver_seen")
    return df.withColumns({"both_seen": both, "unseen_entity": ~both})


def subgroups(df: DataFrame) -> DataFrame:
    """Repeat each row for the full population and for the subgroup it falls in."""
    everyone, known, unseen = SUBGROUPS
    own = F.when(F.col("both_seen"), known).otherwise(unseen)
    return df.withColumn("subgroup", F.explode(F.array(F.lit(everyone), own)))
