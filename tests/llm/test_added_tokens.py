"""Texts that hold the tokenizer's added tokens are encoded as the library does by default."""

import public_tokenizers
from tokenizers import Tokenizer

from veilspark.llm import token_files
from veilspark.llm.queries import TOKENIZER


def test_added_tokens_get_their_ids(spark, tmp_path):
    path = public_tokenizers.path(TOKENIZER)
    model = Tokenizer.from_file(path)
    token = next(iter(model.get_added_tokens_decoder().values())).content
    texts = [token, f"one two {token} three", f"one{token}two\nthree", f"{token} {token}", "one two", f"one {token[:-1]} two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_tokens(docs, f"{tmp_path}/a", path, 2, parts=2)
    found = {r["doc_id"]: list(r["ids"]) for r in token_files.read_tokens(spark, f"{tmp_path}/a").collect()}
    assert found == {i: [*model.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert found[0] == [model.token_to_id(token), 2]
