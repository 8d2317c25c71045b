"""Compaction, manifests and chat formatting against plain versions of their definitions."""

import glob
import hashlib
import random
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from policyloom.llm import chat, compaction, merkle, queries
from policyloom.runtime import scratch_path

tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# --- compaction ---------------------------------------------------------------------------------------------------


def plain_compaction(rows, columns):
    """rows: dicts; files of the final folder by (day, lot, piece), as report() has them but for the path."""
    total = len(rows)
    share = lambda x: 1 + total // x
    day = lambda r: None if r["arrived_at"] is None else (r["arrived_at"].date() - datetime(1970, 1, 1).date()).days
    days, slots = {}, {}
    for r in rows:
        days[day(r)] = days.get(day(r), 0) + 1
    for r in rows:
        h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
        slots.setdefault((day(r), h // 16 % (1 + days[day(r)] // share(150)), min(h % 4, h // 4 % 4)), []).append(r)
    null_first = lambda v: (v is not None, v)
    for held in slots.values():
        held.sort(key=lambda r: (null_first(r["arrived_at"]), null_first(r["click_id"])))
    made = []
    for d in days:
        mine = sorted((k for k in slots if k[0] == d), key=lambda k: (-len(slots[k]), k[1], k[2]))
        groups = [[k] for k in mine if len(slots[k]) >= share(600)]
        opened = []
        for k in (k for k in mine if len(slots[k]) < share(600)):
            fit = next((g for g in opened if sum(len(slots[x]) for x in g) + len(slots[k]) <= share(500)), None)
            fit.append(k) if fit is not None else opened.append([k])
        for g in groups + opened:
            held = [r for k in g for r in slots[k]]
            ids = [r["click_id"] for r in held if r["click_id"] is not None]
            cents = sum(int((100 * r["value"] + 0.5) // 1) for r in held if r["value"] is not None and abs(r["value"]) != float("inf") and r["value"] == r["value"])
            made.append((*g[0], len(held), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{lot}-{piece}" for _, lot, piece in g), H(",".join("" if r["click_id"] is None else str(r["click_id"]) for r in held)), ",".join(columns), len(g) > 1))
    return sorted(made, key=str)


def compacted(spark, frame):
    folder, total = compaction.write_slots(frame, scratch_path(spark, "clicks"))
    before = {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(folder.path.removeprefix("file:") + "/**/*.parquet", recursive=True)}
    made = compaction.compact(folder, compaction.share(total, 600), compaction.share(total, 500))
    found = compaction.report(folder, made).collect()
    left = set(glob.glob(folder.path.removeprefix("file:") + "/**/*.parquet", recursive=True))
    assert {r.path.removeprefix("file:").replace("///", "/") for r in found} == left
    for r in found:
        path = r.path.removeprefix("file:").replace("///", "/")
        assert pq.ParquetFile(path).schema_arrow.names == frame.columns
        assert r.rewritten or before[path] == hashlib.sha256(open(path, "rb").read()).hexdigest()
    return folder, sorted((tuple(r[:9]) + (r.columns, r.rewritten) for r in found), key=str)


def test_compaction_equals_a_plain_one(spark):
    frame = spark.read.parquet(f"{DATA}/clicks.parquet")
    _, got = compacted(spark, frame)
    assert got == plain_compaction([r.asDict() for r in frame.collect()], frame.columns) and any(r[-1] for r in got)


def test_compaction_of_hard_rows(spark):
    random.seed(3)
    start = datetime(1969, 12, 30)
    at = lambda: random.choice([None, start + timedelta(seconds=random.randrange(5 * 86400)), start + timedelta(days=2)])
    rows = [(random.choice([None, k, k, k // 9]), at(), random.choice([None, -1.005, 2.5, float("nan"), float("inf"), 7.125]), "x", 1, 2, "y" * (k % 50)) for k in range(1500)]
    frame = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, slot string, gen int, day int, n_rows string")
    _, got = compacted(spark, frame)
    assert got == plain_compaction([r.asDict() for r in frame.collect()], frame.columns) and {r[0] for r in got} == {None, -2, -1, 0, 1, 2}


def test_compaction_of_no_rows_and_of_one(spark):
    frame = spark.read.parquet(f"{DATA}/clicks.parquet")
    assert compacted(spark, frame.limit(0))[1] == []
    assert [r[3:6] for r in compacted(spark, frame.where("click_id = 3"))[1]] == [(1, 3, 3)]


def test_a_repeated_compaction_ends_the_same(spark):
    """A run that is taken up after the new generation was written, and after files were removed."""
    frame = spark.read.parquet(f"{DATA}/clicks.parquet")
    folder, total = compaction.write_slots(frame, scratch_path(spark, "clicks"))
    made = compaction.compact(folder, compaction.share(total, 600), compaction.share(total, 500))
    ids = lambda: sorted(r[0] for r in folder.read().select("click_id").collect())
    assert ids() == sorted(r.click_id for r in frame.select("click_id").collect())
    removed = made.where("n_files > 1").select(F.concat(F.lit("gen=0/slot="), "slot"))
    assert removed.mapInArrow(compaction._remover("file://" + folder.path.removeprefix("file:")), "path string").count() == removed.count()
    assert ids() == sorted(r.click_id for r in frame.select("click_id").collect())


# --- manifest -----------------------------------------------------------------------------------------------------


def plain_manifest(rows, fanout=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    leaves = {}
    for doc_id, text, lang, source, n_chars in rows:
        other = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            other = text.translate(lower)
        both = [H(*map(field, (doc_id, source, lang, n_chars, t))) for t in (text, other)]
        leaves.setdefault(source, []).append((doc_id is not None, doc_id or 0, *both))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i // fanout * fanout
            yield level[first:i], level[i + 1 : first + fanout]
            i //= fanout

    sources = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for *_, leaf, _ in sorted(leaves[s])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (known, doc_id, leaf, now) in enumerate(sorted(leaves[s])):
            steps = [*path(trees[s], i), *path(top, k)]
            for left, right in steps:
                now = H(*left, now, *right)
            out.append((doc_id if known else None, s, leaf, trees[s][-1][0], top[-1][0], H(*[x for a, b in steps for x in a + b]), now, now == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest_equals_a_plain_one(spark):
    random.seed(5)
    texts = [None, "", "Aé𝄞b", "ABC", "A" * 300_000, "-", "1:-"]
    rows = [(random.choice([None, k, k % 40, -k]), random.choice(texts), random.choice([None, "de", ""]), random.choice([None, "", "a", "a", "a", "é", "Z", ":", "-", f"one{k}"]), random.choice([None, 7])) for k in range(900)]
    for n in (0, 1, 2, 17, 900):
        frame = spark.createDataFrame(rows[:n], DOCS).withColumn("leaf", F.lit("clash")).withColumn("grp", F.lit(1))
        assert sorted(map(tuple, merkle.document_manifest(frame).collect()), key=str) == plain_manifest(rows[:n])


def test_manifest_of_equal_rows(spark):
    rows = [(5, "same", "en", "s", 4)] * 40
    got = merkle.document_manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows) and len(got) == 40


def test_tampering_shows(spark):
    rows = [(k, "Text" if k % 2 else "text", "en", f"s{k % 3}", 4) for k in range(60)]
    got = merkle.document_manifest(spark.createDataFrame(rows, DOCS)).collect()
    broken = {k for k in range(60) if k % 2 and zlib.crc32(str(k).encode()) % 5 == 0}
    assert broken and {r.doc_id for r in got if not r.verified} == broken


# --- chat formatting ----------------------------------------------------------------------------------------------

PATH = tokenizers.path(queries.TOKENIZER)


def plain_chat(rows):
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for key, turns in by.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        size = sum(32 + len(chat.escape(role)) + len(chat.escape(text)) for _, role, text in turns)
        out.append((key, len(turns), H(*[f"{role}\n{text}\n" for _, role, text in turns]), len(loss), H(loss), size))
    return sorted(out, key=str)


def hard_text(rnd):
    pieces = ["<|im_end|>", "<|im_start|>assistant", "<|", "<\\|", "<\\\\|", "<", "|", "\\", "\n", " ", "  ", "\x00", "é", "𝄞", "<|endoftext|>", "<|im_sep|>", "word", " ", "'s"]
    return "".join(rnd.choice(pieces) for _ in range(rnd.randrange(9)))


def test_escapes_are_reversible():
    rnd = random.Random(1)
    for _ in range(2000):
        text = hard_text(rnd)
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_masks_follow_offsets():
    rnd, encoder = random.Random(2), chat.tokenizer(PATH)
    for _ in range(200):
        turns = [(rnd.choice(["user", "assistant", hard_text(rnd)]), hard_text(rnd)) for _ in range(rnd.randrange(1, 6))]
        formatted, spans = chat.render(turns)
        made = encoder.encode(formatted, add_special_tokens=False)
        mask = chat.loss_mask(chat.np.array(made.offsets).reshape(-1, 2), spans)
        plain = [any(a <= x and y <= b and x < y for a, b, loss in spans if loss) for x, y in made.offsets]
        assert mask.tolist() == plain and chat.parse(formatted) == turns
        assert sum(made.tokens[k] in (chat.START, chat.SEP, chat.END) for k in range(len(made.tokens))) == 3 * len(turns)


def test_chat_equals_a_plain_version(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 2, 2, -1, k]), rnd.choice([None, k, k % 5]), rnd.choice([None, "user", "assistant", "assistant", "system", "tool<|im_sep|>"]), rnd.choice([None, "", hard_text(rnd), hard_text(rnd)])) for k in range(400)]
    rows += [(7, 1, "assistant", "long " * 200_000), (7, 1, "assistant", "x" * 300_000), (8, 0, "user", "same"), (8, 0, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, chat.round_trip(frame, PATH).collect()), key=str) == plain_chat(rows)
    assert chat.round_trip(frame.limit(0), PATH).count() == 0


def test_segments_change_no_token(spark):
    rows = [(k % 3, k, "assistant" if k % 2 else "user", f"turn {k} <|im_end|>") for k in range(60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)

    def ids(segment):
        out = {}
        for r in chat.format_conversations(frame, PATH, segment).orderBy("conv_id", "segment").collect():
            a, b, c = out.get(r.conv_id, ("", b"", b""))
            out[r.conv_id] = (a + r.formatted, b + bytes(r.token_ids), c + bytes(r.loss_mask))
        return out

    assert ids(40) == ids(1 << 20)
