"""Phrases whose words occur together more often than apart.

Identical pieces of text become one row with a multiplicity. Blocks of pieces code their words as labels and ask once
for each distinct word; words that are frequent enough get a number. A phrase can only be as frequent as its rarest
word, so phrases with a word that has no number are never counted, and the others are short tuples of numbers. Blocks
send them, summed up, to hash buckets, and duckdb counts each bucket out of core. Phrases meet the counts of their parts
through requests that are shuffled to the parts, one for each part and home of phrases."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luminal.llm.common import cut, tasks

BLOCK_WORDS = 1 << 21  # a block holds at most so many words of pieces, and as many again where pieces are long
BUCKET_WORDS = 1 << 26  # words of text for which there is a bucket at least
HOME_PHRASES = 1 << 16  # phrases, on average, of which each part is asked for once
DUCKDB_MEMORY = "160MB"  # of a task that counts; beyond it duckdb spills
SALTS = (4096, 64)  # groups in which the best of a language are found before they meet


def pieces(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, times): the distinct pieces of the texts, words lower-cased (A-Z) and set apart by one space."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09]+", " "))
    parts = F.split(text, r" ?[.,;:!?\x0A-\x0D] ?")
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(parts).alias("piece")).filter("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("times"))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from -1 up as byte planes; the higher planes hardly vary, so they nearly vanish."""
    up = (values + 1).astype("<u8")
    planes = max(1, -(-int(up.max()).bit_length() // 8)) if len(up) else 1
    by_byte = up.view(np.uint8).reshape(-1, 8)
    return bytes([planes]) + zstandard.compress(b"".join(by_byte[:, k].tobytes() for k in range(planes)), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    return out.view("<i8").reshape(-1) - 1


BLOCK = "block long, lang string, n long, words binary, counts binary, lens binary, own binary, labels binary, times binary"


def _coder(most: int):
    """Blocks of pieces, each of one language."""

    def lengths(lists: pa.ListArray, times: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, lengths, words of their own and multiplicities of parts of pieces: a piece of more than
        BLOCK_WORDS words is cut into parts that have the next most - 1 words besides their own."""
        lens = lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(lens) - lens
        parts = -(-lens // BLOCK_WORDS)
        piece = np.repeat(np.arange(len(lens)), parts)
        at = (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)) * BLOCK_WORDS
        own = np.minimum(BLOCK_WORDS, lens[piece] - at)
        return starts[piece] + at, np.minimum(own + most - 1, lens[piece] - at), own, times[piece]

    def block(seq: int, lang: str, codes: np.ndarray, distinct: pa.Array, starts, lens, own, times) -> tuple:
        flat = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        mine = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) < np.repeat(own, lens)
        used, labels = np.unique(codes[flat], return_inverse=True)
        weight = np.repeat(times, lens) * mine
        counts = np.zeros(len(used), np.int64)
        np.add.at(counts, labels, weight)
        words = "\n".join(distinct.take(pa.array(used)).to_pylist()).encode()  # a word has no line feed
        return seq, lang, int(weight.sum()), zstandard.compress(words, 1), pack(counts), pack(lens), pack(own), pack(labels), pack(times)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        seq = TaskContext.get().partitionId() << 40

        def flush(held):
            nonlocal seq, arrow
            arrow = arrow or pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("words", "counts", "lens", "own", "labels", "times")]])
            table = pa.Table.from_batches(held)
            for lang in pc.unique(table["lang"]).to_pylist():
                rows = table.filter(pc.equal(table["lang"], lang))
                lists = pc.split_pattern(rows["piece"], " ").combine_chunks()
                coded = lists.flatten().dictionary_encode()
                # lower-cased words may meet
                again = pc.ascii_lower(coded.dictionary).dictionary_encode()
                codes = again.indices.to_numpy()[coded.indices.to_numpy()]
                starts, lens, own, times = lengths(lists, rows["times"].to_numpy())
                ends = np.cumsum(own)
                first = 0
                while first < len(lens):
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] - own[first] + BLOCK_WORDS, "right")))
                    row = block(seq, lang, codes, again.dictionary, starts[first:last], lens[first:last], own[first:last], times[first:last])
                    seq, first = seq + 1, last
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        held, words = [], 0
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                n = pc.sum(pc.count_substring(part["piece"], " ")).as_py() + part.num_rows
                if held and words + n > BLOCK_WORDS:
                    yield from flush(held)
                    held, words = [], 0
                held.append(part)
                words += n
        if held:
            yield from flush(held)

    return code


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a block."""
    for batch in batches:
        for row in batch.to_pylist():
            words = zstandard.decompress(row["words"]).decode().split("\n")
            n = len(words)
            yield pa.RecordBatch.from_pydict({"block": np.full(n, row["block"]), "label": np.arange(n, dtype=np.int32), "lang": pa.array([row["lang"]] * n, pa.string()), "word": pa.array(words, pa.string()), "n": unpack(row["counts"])})


def _sum_up(table: pa.Table | pa.RecordBatchReader, keys: list[str], least: int = 0) -> pa.Table:
    """Sums of n for each combination of the keys that reach least, counted by duckdb. What does not fit in its
    memory goes to a folder of this task alone, which is gone when the task ends."""
    with tempfile.TemporaryDirectory(prefix="luminal-count-") as folder, duckdb.connect() as con:
        con.execute(f"SET threads = 1; SET memory_limit = '{DUCKDB_MEMORY}'; SET temp_directory = '{folder}'; SET preserve_insertion_order = false")
        con.register("grams", table)
        by = ", ".join(keys)
        return con.sql(f"SELECT {by}, sum(n)::BIGINT AS n FROM grams GROUP BY {by} HAVING sum(n) >= {least}").to_arrow_table()


def _bucket(columns: list[np.ndarray], buckets: int) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of 2^64 over the golden ratio
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def _messages(most: int, buckets: int):
    """A block and the numbers of its words: (bucket, data), phrases of 2 to most words summed up within the block."""
    keys = [f"w{j}" for j in range(most)]

    def phrases(row: dict, ids: np.ndarray) -> pa.Table:
        labels, lens, own, times = (unpack(row[c]) for c in ("labels", "lens", "own", "times"))
        g = ids[labels]
        place = np.arange(len(g)) - np.repeat(np.cumsum(lens) - lens, lens)
        left, alive = np.repeat(lens, lens) - place, (g >= 0) & (place < np.repeat(own, lens))
        weight, tables = np.repeat(times, lens), []
        for k in range(2, most + 1):
            alive = alive & (left >= k)
            alive[: len(g) - k + 1] &= g[k - 1 :] >= 0
            at = np.flatnonzero(alive)
            tables.append(pa.table({key: g[at + j] if j < k else np.full(len(at), -1) for j, key in enumerate(keys)} | {"n": weight[at]}))
        return _sum_up(pa.concat_tables(tables), keys)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"bucket": [], "data": []}
        for row in left.to_pylist():
            ids = np.full(len(unpack(row["counts"])), -1)
            ids[right["label"].to_numpy()] = right["id"].to_numpy()
            found = phrases(row, ids)
            columns = [found[c].to_numpy() for c in (*keys, "n")]
            to = _bucket(columns[:-1], buckets)
            order = np.lexsort((*reversed(columns[:-1]), to))
            columns, to = [c[order] for c in columns], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                data = [pack(c[a:b]) for c in columns]
                out["bucket"].append(int(to[a]))
                out["data"].append(np.array([len(d) for d in data], "<u4").tobytes() + b"".join(data))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    return send


def _counter(most: int, least: int):
    """The phrases of a bucket that occur least times: messages run through duckdb as a stream."""
    keys = [f"w{j}" for j in range(most)]
    arrow = pa.schema([(c, pa.int64()) for c in (*keys, "n")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened():
            for batch in batches:
                for data in batch["data"]:
                    data = data.as_py()
                    ends = np.cumsum(np.frombuffer(data, "<u4", most + 1)) + 4 * (most + 1)
                    columns = [unpack(data[a:b]) for a, b in zip([4 * (most + 1), *ends[:-1]], ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

        found = _sum_up(pa.RecordBatchReader.from_batches(arrow, opened()), keys, least)
        yield from found.select([*keys, "n"]).to_batches()

    return count


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, n) and phrases (w0 .. w<most - 1> of ids, -1 beyond the phrase, n) that occur least
    times, and (lang, n) of all words. All three are written tables."""
    spark = df.sparkSession
    blocks = cut(pieces(df, lang_col, text_col).mapInArrow(_coder(most), BLOCK), "phrase-blocks")
    totals = cut(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    asks = blocks.select("block", "lang", "words", "counts").mapInArrow(_asks, "block long, label int, lang string, word string, n long")
    words = asks.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = cut(words.withColumn("id", F.monotonically_increasing_id()), "phrase-words")
    # numbers close together: the place in a task times the number of tasks, and the task
    dense = words.agg(F.max(F.shiftright("id", 33)).alias("m")).first().m
    words = words.withColumn("id", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) * F.lit((dense or 0) + 1) + F.shiftright("id", 33))
    size = blocks.agg(F.sum(F.octet_length("labels")).alias("n")).first().n or 0  # a byte or two for a word
    buckets = max(tasks(spark), size // BUCKET_WORDS)
    known = asks.select("block", "label", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "label", "id")
    sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_messages(most, buckets), "bucket long, data binary")
    keys = [f"w{j}" for j in range(most)]
    counted = sent.repartition(buckets, "bucket").mapInArrow(_counter(most, least), ", ".join(f"{c} long" for c in (*keys, "n")))
    return words, cut(counted, "phrase-counts"), totals


def _with_parts(phrases: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """phrases with the words, and the counts of all first and last parts: lang, word<j>, l<k>, r<k>.

    Each home of phrases asks once for each of its parts, so no part is asked for by all phrases that have it."""
    keys = [f"w{j}" for j in range(most)]
    homes = max(1, phrases.count() // HOME_PHRASES)
    phrases = phrases.withColumn("home", F.pmod(F.xxhash64(*keys), F.lit(homes)))
    wanted = []
    for k in range(2, most + 1):
        ids = [F.col(c) for c in keys[:k]]
        parts = {f"word{j}": [ids[j]] for j in range(k)} | {f"l{i}": ids[:i] for i in range(1, k)} | {f"r{i}": ids[i:] for i in range(1, k)}
        some = phrases.filter((F.col(keys[k - 1]) >= 0) & (F.col(keys[k]) < 0 if k < most else F.lit(True)))
        wanted.append(some.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("role"), F.array(*part).alias("part")) for name, part in parts.items()])).alias("p")).select(*keys, "n", "home", "p.role", "p.part"))
    wanted = _union(wanted)
    counts = words.select(F.array("id").alias("part"), F.col("n").alias("count"), "lang", "word")
    for k in range(2, most):
        some = phrases.filter((F.col(keys[k - 1]) >= 0) & (F.col(keys[k]) < 0))
        counts = counts.unionByName(some.select(F.array(*keys[:k]).alias("part"), F.col("n").alias("count"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word")))
    answers = wanted.select("home", "part").distinct().join(counts, "part")
    met = wanted.join(answers, ["home", "part"])
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return met.groupBy(*keys, "n").agg(
        F.max("lang").alias("lang"),
        *[of(f"word{j}", "word").alias(f"word{j}") for j in range(most)],
        *[of(f"{side}{i}", "count").alias(f"{side}{i}") for side in "lr" for i in range(1, most)],
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _score(most: int) -> Column:
    """The lowest-scoring cut as a struct (score, k, l, r). A product of three counts of 13 digits fits a decimal."""
    cuts = []
    for k in range(1, most):
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * n * n) div (cast(l{k} as decimal(19,0)) * r{k})")
        cuts.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    return F.array_min(F.array(*cuts))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 3, least: int = 10, keep: int | None = 2000, share: int = 50) -> DataFrame:
    """Phrases of 2 to most words that occur least times, by lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at marks and line breaks into pieces, those at blanks into words. a, l and r
    count the phrase and the parts of its lowest-scoring cut (ties: the smallest) over all texts, n all words of the
    language; score is floor(1000000 * a * a / (l * r)). A phrase is dropped if it lies inside a longer one that occurs
    at least share percent as often. keep: the first so many of each language by score, a (both descending) and phrase
    in order of bytes; None keeps all, with rank null.

    A null language counts as und, null and empty texts have no words, repeated rows count again, texts and pieces of
    any length are counted whole, and an empty table gives an empty result. Other columns of df play no part. Counts
    up to 10^13 are exact."""
    words, phrases, totals = phrase_counts(df, lang_col, text_col, most, least)
    keys = [f"w{j}" for j in range(most)]
    inside = []
    for k in range(3, most + 1):
        some = phrases.filter((F.col(keys[k - 1]) >= 0) & (F.col(keys[k]) < 0 if k < most else F.lit(True)))
        subs = [keys[i : i + m] for m in range(2, k) for i in range(k - m + 1)]
        inside.append(some.select("n", F.explode(F.array(*[F.array(*s, *[F.lit(-1).cast("long")] * (most - len(s))) for s in subs])).alias("sub")))
    scored = _with_parts(phrases, words, most)
    if inside:
        longer = _union(inside).groupBy("sub").agg(F.max("n").alias("longest"))
        scored = scored.withColumn("sub", F.array(*keys)).join(longer, "sub", "left")
        scored = scored.filter(F.coalesce(F.col("longest") * 100 < F.col("n") * share, F.lit(True)))
    best = scored.withColumn("best", _score(most)).select("lang", F.concat_ws(" ", *[f"word{j}" for j in range(most)]).alias("phrase"), F.col("n").alias("a"), "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if keep is None:
        best = best.withColumn("rank", F.lit(None).cast("long"))
    else:
        for salt in SALTS:
            place = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salt))).orderBy(*order))
            best = best.withColumn("rank", place).filter(F.col("rank") <= keep)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
