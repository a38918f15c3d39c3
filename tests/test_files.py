import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from affectlake.sinks import results
from affectlake.sources import files, registry


def test_vad_corpus(spark, write):
    write("eb/emobank.csv", 'id,split,V,A,D,text\nx_1,train,3.0,2.5,3.1,"Hi, ""you""!\nThere"\nx_2,dev,1,2,3,\'ok\'\nx_3,test,2,2,2,z\nx_4,other,1,1,1,no\n')
    path = write("eb/readme", "").rsplit("/", 1)[0]
    rows = {r["id"]: r for r in registry.load_corpus(spark, "emobank", path).collect()}
    assert rows["x_1"]["text"] == 'Hi , " you " ! There' and tuple(rows["x_1"]["label"]) == (3.0, 2.5, 3.1)
    assert {i: r["split"] for i, r in rows.items()} == {"x_1": "train", "x_2": "valid", "x_3": "test"}
    raw = registry.load_corpus(spark, "emobank", path, clean=False).filter("id = 'x_1'").first()
    assert raw["text"] == 'Hi, "you"!\nThere'


def test_metadata_and_annotations(spark, write):
    meta = write("meta.tsv", "id\tdocument\tcategory\tsubcategory\na\tD1\tnews\tn1\nb\tD2\tfiction\t\n")
    assert [tuple(r) for r in files.read_metadata(spark, meta).orderBy("id").collect()] == [("a", "D1", "news", "n1"), ("b", "D2", "fiction", None)]
    notes = write("reader.csv", "id,V,A,D,stdV,stdA,stdD,N\na,2.6,3.0,2.6,0.1,0.2,0.3,5\n")
    assert tuple(files.read_annotations(spark, notes).first()) == ("a", 2.6, 3.0, 2.6, 0.1, 0.2, 0.3, 5)


def test_tweets(spark, write):
    from affectlake.functions.labels import TWEET_LABELS

    head = "ID\tTweet\t" + "\t".join(TWEET_LABELS)
    for split, part in files.TWEET_FILES.items():
        hot = "\t".join("1" if n in ("joy", "trust") else "0" for n in TWEET_LABELS)
        write(f"t/{files.TWEET_PREFIX}{part}.txt", f"{head}\n{split}-1\t@me so &amp; so http://t.co/a 😂\\nok\t{hot}\n")
    root = write("t/x", "").rsplit("/", 1)[0]
    rows = registry.load_corpus(spark, "semeval", root).collect()
    assert Counter(r["split"] for r in rows) == {"train": 1, "valid": 1, "test": 1}
    assert rows[0]["label"] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1]
    assert rows[0]["text"] == "so & so :face_with_tears_of_joy: ok"


def test_statements(spark, write):
    names = ["joy", "fear", "anger"]
    lines = ["ID,SIT,EMOT,X,Field1"] + [f'{i},"When á\nI {i}  passed.",{i % 3 + 1}.0,9,{names[i % 3]}' for i in range(30)]
    path = write("isear.csv", "\n".join(lines) + "\n")
    rows = registry.load_corpus(spark, "isear", path).collect()
    assert len({r["id"] for r in rows}) == 30
    assert Counter(r["split"] for r in rows) == {"train": 21, "valid": 4, "test": 5}
    assert Counter(r["label"] for r in rows) == {3: 10, 0: 10, 1: 10}
    assert all(r["text"].startswith("When I ") for r in rows)
    bad = write("bad.csv", "SIT,EMOT,Field1\nx,1,bliss\n")
    with pytest.raises(Exception, match="unknown label"):
        registry.load_corpus(spark, "isear", bad).collect()


def test_stance_rows_are_skipped_by_position(spark, write):
    def line(i):
        return "\t".join(["Anger" if i % 2 else "---", "anticipation", *["---"] * 6, f"text {i}"])

    path = write("ssec/train-combined-0.0.csv", "\n".join(line(i) for i in range(40)) + "\n")
    write("ssec/test-combined-0.0.csv", "\n".join(line(100 + i) for i in range(5)) + "\n")
    kept = files.read_stance_tweets(spark, path, skip_first=15)
    assert sorted(int(r["text"][5:]) for r in kept.collect()) == list(range(15, 40))
    kept = files.read_stance_tweets(spark, path, skip_lines=[1, 7])
    assert sorted(int(r["text"][5:]) for r in kept.collect()) == [i for i in range(40) if i not in (0, 6)]
    rows = registry.load_corpus(spark, "ssec", path.rsplit("/", 1)[0], skip_first=20).collect()
    assert Counter(r["split"] for r in rows) == {"train": 16, "valid": 4, "test": 5}
    one = next(r for r in rows if r["text"] == "text 101")
    assert one["split"] == "test" and one["label"] == [1, 1, 0, 0, 0, 0, 0, 0]


def test_row_numbers_follow_the_file_across_blocks(spark, write):
    path = write("long.tsv", "\n".join(["\t".join(["-"] * 8 + [f"row {i}"]) for i in range(3000)]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = files.read_stance_tweets(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        got = files.with_row_numbers(rows).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(int(r["text"][4:]) == r["row_no"] - 1 for r in got) and len(got) == 3000


def test_forum_posts(spark, write):
    for i, part in enumerate(files.FORUM_FILES.values()):
        write(f"g/{part}.tsv", f'"Quoted" text, ok.\t{i},2{i}\tid{i}\n')
    root = write("g/x", "").rsplit("/", 1)[0]
    rows = {r["id"]: r for r in registry.load_corpus(spark, "goemotions", root).collect()}
    assert [i for i, y in enumerate(rows["id1"]["label"]) if y] == [1, 21] and len(rows["id1"]["label"]) == 28
    for i, part in enumerate(files.FORUM_FILES.values()):
        write(f"e/{part}.tsv", f"x\t{i}\tid{i}\n")
    root = write("e/x", "").rsplit("/", 1)[0]
    assert registry.load_corpus(spark, "ekman", root).filter("id = 'id2'").first()["label"] == [0, 0, 1, 0, 0, 0, 0]


@pytest.fixture
def dialogues(write):
    path = None
    for n in range(1, 6):
        name = f"Ses0{n}F_impro01"
        blocks = ["% [START_TIME - END_TIME]\tTURN_NAME\tEMOTION\t[V, A, D]\n"]
        talk = []
        for u, code in enumerate(["neu", "xxx", "exc", "fru"]):
            blocks.append(f"[6.2901 - 8.2357]\t{name}_F00{u}\t{code}\t[2.5000, 3.{u}000, 1.5000]\nC-E2:\tNeutral;\t()\n")
            talk.append(f"{name}_F00{u} [006.2901-008.2357]: Well: no{u}?")
        talk.append(f"{name}_F000 [009.0-010.0]: Said again.")
        write(f"I/Session{n}/dialog/EmoEvaluation/{name}.txt", "\n".join(blocks) + "\n\n")
        write(f"I/Session{n}/dialog/EmoEvaluation/Categorical/{name}_e1.txt", "not read")
        write(f"I/Session{n}/dialog/EmoEvaluation/notes.anvil", "not read")
        path = write(f"I/Session{n}/dialog/transcriptions/{name}.txt", "\n".join(talk) + "\n")
    return path.split("/Session")[0]


def test_dialogues(spark, dialogues):
    rows = registry.load_corpus(spark, "iemocap-cat", dialogues).collect()
    assert len(rows) == 15 and Counter(r["split"] for r in rows) == {"train": 12, "valid": 1, "test": 2}
    assert Counter(r["label"] for r in rows) == {"neutral": 5, "excite": 5, "frustrate": 5}
    text = {r["id"]: r["text"] for r in rows}
    assert text["Ses03F_impro01_F000"] == "Said again ." and text["Ses03F_impro01_F002"] == "Well : no2 ?"
    vad = {r["id"]: tuple(r["label"]) for r in registry.load_corpus(spark, "iemocap-vad", dialogues).collect()}
    assert vad["Ses05F_impro01_F003"] == (2.5, 3.3, 1.5)


def test_lexicon_last_line_wins(spark, write):
    path = write("lex.txt", "Word\tValence\tArousal\tDominance\njoy\t0.9804\t0.8\t0.7\nanger\t0.1\t0.9\t0.6\njoy\t0.1236\t0.1\t0.1\n")
    got = {r["word"]: (r["v"], r["a"], r["d"]) for r in files.read_lexicon(spark, path).collect()}
    assert got == {"joy": (0.124, 0.1, 0.1), "anger": (0.1, 0.9, 0.6)}


def test_job_specification(spark, write):
    good = {"task": "vad-regression", "model": "bert", "dataset": "emobank", "load_model": "pretrained_lm", "label_type": "dimensional", "optimizer_type": "trans", "max_seq_len": 256}
    path = write("job.json", json.dumps(good, indent=2))
    job = registry.read_job(spark, path)
    assert job.first()["max_seq_len"] == 256 and registry.job_violations(job).count() == 0
    path = write("bad.json", json.dumps({**good, "task": "sing", "model": None}))
    bad = {tuple(r) for r in registry.job_violations(registry.read_job(spark, path)).collect()}
    assert bad == {("task", "sing"), ("model", None)}
    with pytest.raises(ValueError):
        registry.load_corpus(spark, "nope", path)


def test_corpus_writers(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "train", 1.0, 2.0, 3.0, ' "x",\n y ', "d", "c", "s")],
        "id string, split string, V double, A double, D double, text string, document string, category string, subcategory string",
    )
    results.write_split_corpus(rows, str(tmp_path / "c"))
    assert tuple(files.read_vad_corpus(spark, str(tmp_path / "c")).first()) == ("a", "train", 1.0, 2.0, 3.0, ' "x",\n y ')
    results.write_split_corpus(rows, str(tmp_path / "p"), form="parquet")
    back = spark.read.parquet(str(tmp_path / "p")).filter("split = 'test'")
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()
    results.write_combined_corpus(rows.coalesce(1), str(tmp_path / "q"))
    lines = next((tmp_path / "q").glob("part*.csv")).read_text().splitlines()
    assert lines[0] == '"id","V","A","D","text"' and lines[1].startswith('"a","1.0","2.0","3.0"," ""x"",')
    with pytest.raises(Exception):
        results.write_combined_corpus(rows, str(tmp_path / "q"))


def test_result_log(spark, tmp_path):
    assert [len(results.layout_columns(k)) for k in ("vad", "multi", "single")] == [19, 17, 13]
    assert results.layout_of("vad", "isear") == "vad" and results.layout_of("cat", "isear") == "single" and results.layout_of("cat", "semeval") == "multi"
    path = str(tmp_path / "log")
    names = results.layout_columns("single")
    row = spark.range(1).select(*[F.lit(1).alias(c) if c != "file_name" else F.lit("f").alias(c) for c in names])
    assert results.read_log(spark, "single", path).collect() == []
    for form in ("parquet", "csv"):
        log = f"{path}-{form}"
        for epoch in (2, 1, 2, 2):  # a retried append takes the place of the first
            assert results.log_evaluation(row.withColumn("epoch", F.lit(epoch)), "single", log, form)
        stored = results.read_log(spark, "single", log, form)
        assert stored.columns == names and sorted((r.file_name, r.epoch, r.valid_acc) for r in stored.collect()) == [("f", 1, 1.0), ("f", 2, 1.0)]
        assert results.log_evaluation(row.withColumn("file_name", F.lit("g")), "single", log, form)
        assert results.read_log(spark, "single", log, form).count() == 3
    assert not results.log_evaluation(row.drop("valid_acc"), "single", path)
    results.export_log(results.read_log(spark, "single", f"{path}-csv", "csv"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == ",".join(names) and [x.split(",")[:2] for x in lines[1:]] == [["1", "f"], ["2", "f"], ["1", "g"]]


def test_lexicon_of_several_files(spark, write):
    write("lex/a.tsv", "word\tv\ta\td\njoy\t0.1\t0.2\t0.3\nfear\t0.5\t0.5\t0.12345\njoy\t0.4\t0.5\t0.6\n")
    path = write("lex/b.tsv", "word\tv\ta\td\nfear\t0.7\t0.8\t0.9\n")
    got = {r.word: (r.v, r.a, r.d) for r in files.read_lexicon(spark, path.rsplit("/", 1)[0]).collect()}
    assert got == {"joy": (0.4, 0.5, 0.6), "fear": (0.7, 0.8, 0.9)}
    plan = files.read_lexicon(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_named_files_are_written_where_the_rows_are(spark, tmp_path):
    root = tmp_path / "s"
    rows = [(str(root / f"d{i % 2}"), f"f{i}.txt", f"é {i}\nend") for i in range(20)]
    for _ in range(2):  # a second run takes the place of the first
        results.write_named_files(spark.createDataFrame(rows, "folder string, name string, value string").repartition(3))
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*.*")) == sorted(f"d{i % 2}/f{i}.txt" for i in range(20))
    assert (root / "d1/f3.txt").read_bytes() == "é 3\nend\n".encode()
    read = files.read_whole_files(spark, [str(root / "d0"), str(root / "d1")])
    assert {tuple(r) for r in read.collect()} == {(f"f{i}", f"é {i}\nend\n") for i in range(20)}


def test_dialogue_folders_hold_a_file_per_conversation(spark, tmp_path):
    from affectlake.plans.file_queries import _dialogue_folders

    ids = [1, 2, 2, 7, None, -12345678]  # the last two have no session
    rows = [(i, n, "user", f"t {n}", 1) for n, i in enumerate(ids)]
    made = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_chars int")
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    root = _dialogue_folders(spark, str(tmp_path))
    for kind in ("evaluations", "transcripts"):
        read = files.read_whole_files(spark, files.dialogue_folders(root, kind))
        assert sorted(r["file"] for r in read.collect()) == ["Ses00000001", "Ses00000002", "Ses00000007"]
