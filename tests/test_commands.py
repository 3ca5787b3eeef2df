"""Commands do what is left to do, and no more."""

from parsewright import cli


def run(spark, *args):
    cli.main([str(a) for a in args], spark)


def count(spark, folder):
    return spark.read.parquet(str(folder)).count()


def test_a_second_run_adds_nothing(spark, tmp_path):
    raw, parsed, chunks, vectors = (tmp_path / k for k in ("raw", "parsed", "chunks", "vectors"))
    raw.mkdir()
    for k in range(3):
        (raw / f"doc{k}.txt").write_text(f"# Title {k}\n" + "Nurses slept well. " * (20 * k + 1))
    for _ in range(2):
        run(spark, "parse-docs", raw, parsed, "--glob", "*.txt")
        assert count(spark, parsed) == 3
    (raw / "late.txt").write_text("<i>late</i>")
    run(spark, "parse-docs", raw, parsed, "--glob", "*.txt")
    assert count(spark, parsed) == 4 and count(spark, f"{parsed}.errors") == 0
    for chunker in ("LengthChunker", "StructureChunker"):
        found = []
        for _ in range(2):
            run(spark, "chunking", parsed, chunks, "-c", chunker, "--size", 30, "--overlap", 5)
            found.append(count(spark, chunks))
        assert found[0] == found[1] > 4
    for force in ((), (), ("--force",)):
        run(spark, "embed", chunks, vectors, *force)
        assert count(spark, vectors) == count(spark, chunks)
