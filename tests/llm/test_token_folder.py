"""Token files in a named folder are decoded from that folder alone."""

import shutil
import zlib

import pytest

from pulsefleet.llm import queries, token_files


def test_a_copied_folder_is_enough(spark, tmp_path):
    docs = spark.createDataFrame([(2, "the second text"), (1, "a first text"), (None, None), (3, "word " * 900)], "doc_id long, text string")
    small = token_files.Layout(block=512, lanes=8, every=16, file_tokens=300)
    first = tmp_path / "first"
    got = token_files.encoded_and_read(docs, queries.tokenizer_path(), queries.END_ID, small, folder=str(first)).collect()
    shutil.copytree(first, tmp_path / "copy")
    again = token_files.read(token_files.opened(spark, str(tmp_path / "copy"))).collect()
    assert len(got) == 4 and {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in again} == {tuple(r) for r in got}
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in again)
    with pytest.raises(FileExistsError):
        token_files.write(docs, queries.tokenizer_path(), queries.END_ID, small, folder=str(first))


def test_the_query_writes_to_the_named_folder(spark, data, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    spark.conf.set(queries.TOKEN_FOLDER, folder)
    try:
        got = queries.op2_token_ids(spark, data).collect()
    finally:
        spark.conf.unset(queries.TOKEN_FOLDER)
    again = token_files.read(token_files.opened(spark, folder), with_ids=False).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
