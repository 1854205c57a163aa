"""Every named query against its SQL, and the entry without the training-data operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from lexiloom.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FEW = ["gold_words", "validate_errors", "describe_words", "tp_relative_ftp", "evaluate_tp", "dibs_model_phrasal", "error_summary_tp", "fold_assignment", "mattr", "oracle_probability", "diphone_dump", "dpseg_folds", "adaptor_vote", "text_lines", "parse_vote", "stimuli_choice", "fold_repair", "describe_all", "syllabify_phones", "prepare_syllable", "nested_tokens", "chat_cleaned", "chat_phonologised", "sql_tokens", "sql_prepared", "sql_syllables", "ari_units_tp", "error_summary_lines", "puddle_known", "puddle_known_frequency", "frozen_viterbi", "sql_best_words"]


def same(found, wanted):
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(found) == rows(wanted)


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return connection


@pytest.mark.parametrize("name", FEW)
def test_query(spark, data, duck, name):
    same(catalog.queries()[name](spark, data).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())


def test_every_query_but_the_learners_texts_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"puddle_online_text", "puddle_folds_text"}
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "lexiloom"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    if (tmp_path / "lexiloom" / "llm").exists():
        shutil.rmtree(tmp_path / "lexiloom" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'tp_relative_ftp' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
