"""op3: all documents in sequences of 1024 tokens. SQL has no tokenizer, so the tests check the packing itself."""

from .packing import pack


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict = {}
