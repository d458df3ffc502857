"""Train the byte-level BPE fixture tokenizer (2,000 tokens, 256-byte alphabet, no prefix
space) on sf0.001 ``documents`` with the ``tokenizers`` library. Run once; output is committed.
Training is deterministic for a given input and library version."""

import sys

import pyarrow.parquet as pq
from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

src = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001/documents.parquet"
out = sys.argv[2] if len(sys.argv) > 2 else "tokenlens/resources/bytebpe-2k.json"
texts = pq.read_table(src, columns=["text"]).column("text").to_pylist()
tok = Tokenizer(models.BPE())
tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
tok.decoder = decoders.ByteLevel()
trainer = trainers.BpeTrainer(vocab_size=2000, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
                              special_tokens=["<|endoftext|>"], show_progress=False)
tok.train_from_iterator(texts, trainer=trainer)
tok.save(out)
print(out, tok.get_vocab_size())
