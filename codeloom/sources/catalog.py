"""Tasks, their files, readers and length limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPLITS = ("train", "dev", "test")
# Task and sub-task; reader; source and target file below the data folder, with {split} for train, dev, test
# and {stem} for train, valid, test; largest source and target length.
TASKS = (
    *[("summarize", lang, "summarize", f"summarize/{lang}/{{stem}}.jsonl", None, 256, 128) for lang in ("ruby", "javascript", "go", "python", "java", "php")],
    ("translate", "java-cs", "line_pairs", "translate/{stem}.java-cs.txt.java", "translate/{stem}.java-cs.txt.cs", 320, 256),
    ("translate", "cs-java", "line_pairs", "translate/{stem}.java-cs.txt.cs", "translate/{stem}.java-cs.txt.java", 320, 256),
    *[
        (task, size, "line_pairs", f"{task}/{size}/{{stem}}.buggy-fixed.buggy", f"{task}/{size}/{{stem}}.buggy-fixed.fixed", *lengths)
        for task in ("refine", "refine-concrete", "refine-commit")
        for size, lengths in (("small", (130, 120)), ("medium", (240, 240)))
    ],
    ("concode", "none", "nl_code", "concode/{split}.json", None, 320, 150),
    ("defect", "none", "defect", "defect/{stem}.jsonl", None, 512, 3),
    ("translate-500", "none", "line_pairs", "translate-500/{stem}.java-cs.txt.java", "translate-500/{stem}.java-cs.txt.cs", 320, 256),
    ("clone", "none", "clone", "clone/{stem}.txt", "clone/data.jsonl", None, None),
)
CATALOG_SCHEMA = (
    "task string, sub_task string, split string, reader string, source_file string, target_file string, "
    "max_source_length int, max_target_length int"
)


def task_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per (task, sub_task, split): a table of fixed size, safe to broadcast."""
    rows = []
    for task, sub, reader, source, target, *lengths in TASKS:
        for split in SPLITS:
            marks = {"split": split, "stem": "valid" if split == "dev" else split}
            files = [None if f is None else f"{root}/{f.format(**marks)}" for f in (source, target)]
            rows.append((task, sub, split, reader, *files, *lengths))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
