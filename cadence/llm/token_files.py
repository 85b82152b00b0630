"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

Documents are range-sorted by id; each partition writes one shard of three files: ids of tokens one after another
(.tok, uint16 or uint32 by the vocabulary), n + 1 int64 offsets into it (.off) and int64 document ids (.doc).
A shard's base, the tokens of all shards before it, is a prefix sum over the shards' totals, which are as many rows
as there are partitions.

If the tokenizer treats the pieces of a text between ASCII white space apart from each other, because its
pre-tokenizer drops white space, tokens of a piece are kept and reused; pieces not yet seen go to the library in
batches. With any other tokenizer whole texts go to the library.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.common import Published, mapped, open_store, partitions

#: Stands for a null id in .doc files; it sorts first, as null does.
NULL_ID = -(2**63)
#: Pieces whose tokens a worker process keeps; later ones are encoded each time they are met.
KEPT_PIECES = 500_000
#: Characters of a text by which rows of one id are dealt to shards; a text's order begins with theirs.
RANGE_CHARS = 16
_ENCODERS: dict[str, "PieceEncoder"] = {}


#: Normalizers that change no character over white space, and pre-tokenizers that drop white space.
_LOCAL_NORMALIZERS = {"NFC", "NFD", "Lowercase"}
_DROPPING = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer, by its JSON, surely encodes texts as their pieces between ASCII white space one by one.

    False is always right: whole texts are then encoded.
    """

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else [x for p in part[inner] for x in steps(p, inner)] if part["type"] == "Sequence" else [part]

    def probe(step: dict) -> bool:
        """A pattern split that keeps matches alone, none of which can hold white space."""
        pattern = step.get("pattern", {}).get("Regex")
        if step["type"] != "Split" or step.get("behavior") != "Removed" or not step.get("invert") or pattern is None or re.search(r"\(\?[=!<]", pattern):
            return False
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        return not any(ws in piece for ws in "\t\n\x0b\x0c\r " for text in (f"a{ws}b", f"a {ws}{ws}b", f".{ws}.", f"{ws}1{ws}", f"a{ws}'s") for piece, _ in split.pre_tokenize_str(text))

    local = all(
        n["type"] in _LOCAL_NORMALIZERS or (n["type"] == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " ")
        for n in steps(spec.get("normalizer"), "normalizers")
    )
    first = next(iter(steps(spec.get("pre_tokenizer"), "pretokenizers")), None)
    prefixed = any(p.get("add_prefix_space") for p in steps(spec.get("pre_tokenizer"), "pretokenizers"))
    added = spec.get("added_tokens") or []
    plain = not any(t["lstrip"] or t["rstrip"] or set(t["content"]) & set(" \t\n\x0b\x0c\r") for t in added)
    return local and first is not None and (first["type"] in _DROPPING or probe(first)) and not prefixed and plain


class PieceEncoder:
    """Texts to bytes of token ids, through tokens kept by piece where that gives the same."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = drops_white_space(json.loads(self.tokenizer.to_str()))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.kept: dict[bytes, bytes] = {}
        # a special token cuts a text before anything else happens, so it can stand between pieces encoded in one go
        plain = ((i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word))
        self.cut_id, cut = next(plain, (None, None))
        self.cut = cut.content if cut else None

    @classmethod
    def of(cls, tokenizer_path: str) -> "PieceEncoder":
        """The worker process's encoder, which lives on from task to task."""
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = cls(tokenizer_path)
        return _ENCODERS[tokenizer_path]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            encoded = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in encoded]
        split = [(t or "").encode().split() for t in texts]
        found = [list(map(self.kept.get, pieces)) for pieces in split]
        missing = [[j for j, i in enumerate(ids) if i is None] for ids in found]
        known = self._encoded(list({pieces[j] for pieces, at in zip(split, missing, strict=True) for j in at}))
        for pieces, ids, at in zip(split, found, missing, strict=True):
            for j in at:
                ids[j] = known[pieces[j]]
        if len(self.kept) + len(known) <= KEPT_PIECES:
            self.kept |= known
        return [b"".join(ids) for ids in found]

    def _encoded(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Each piece's tokens; many pieces go to the library as one text where none of them holds the cutting token."""
        step = 256 if self.cut else 1
        groups = [pieces[i : i + step] for i in range(0, len(pieces), step)]
        out: dict[bytes, bytes] = {}
        for i in range(0, len(groups), 64):
            texts, owners = [], []
            for group in groups[i : i + 64]:
                own = [p.decode() for p in group]
                joined = (self.cut or "").join(own)
                if self.cut and joined.count(self.cut) == len(own) - 1:
                    texts.append(joined)
                    owners.append(group)
                else:
                    texts += own
                    owners += [[p] for p in group]
            for owner, enc in zip(owners, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(enc.ids, self.dtype)
                cuts = np.flatnonzero(ids == self.cut_id).tolist() if len(owner) > 1 else []
                data, size = ids.tobytes(), self.dtype.itemsize
                starts, ends = [0, *(size * (c + 1) for c in cuts)], [*(size * c for c in cuts), len(data)]
                for piece, a, b in zip(owner, starts, ends, strict=True):
                    out[piece] = data[a:b]
        return out


def _in_parts(texts, most_chars: int = 500_000):
    """Slices of texts with a bounded number of characters (one text at least)."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t or "") > most_chars:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "")
    if part:
        yield part


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text, append `end_id`, and write shards in ascending id order to `folder`; returns the manifest.

    `folder` is a URI that driver and executors share; `tokenizer_path` is a file on each of them. Null texts are
    empty (the end id alone). Rows with equal ids are ordered by text; null ids come first. An empty table gives no
    shard. Files appear whole under names fixed by the partition, so repeated tasks do no harm. Rows of one id are
    spread over shards by the start of the text. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = (F.col("id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS).asc_nulls_first())
    rows = rows.repartitionByRange(partitions(spark), *ranges).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, files, total, offsets, ids = None, None, 0, [0], []
        for batch in batches:
            for row in range(0, batch.num_rows, 1024):
                part = batch.slice(row, 1024)
                ids += [NULL_ID if x is None else x for x in part.column(0).to_pylist()]
                for texts in _in_parts(part.column(1).to_pylist()):
                    if encoder is None:
                        encoder = PieceEncoder.of(tokenizer_path)
                        end = np.array([end_id], encoder.dtype).tobytes()
                        files = Published(f"{folder}/shard-{shard:05d}.tok")
                    for data in encoder(texts):
                        total += len(data) // encoder.dtype.itemsize + 1
                        offsets.append(total)
                        files.write(data + end)
        if files is not None:
            files.close()
            for name, values in (("off", offsets), ("doc", ids)):
                out = Published(f"{folder}/shard-{shard:05d}.{name}")
                out.write(np.array(values, "<i8").tobytes())
                out.close()
        dtype = encoder.dtype.str if encoder else "<u2"
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(ids)], "tokens": [total], "dtype": [dtype]})

    shards = sorted(tuple(r) for r in rows.mapInArrow(write, "shard long, docs long, tokens long, dtype string").collect())
    base, listed = 0, []
    for shard, n, tokens, dtype in shards:
        if n:
            listed.append({"shard": shard, "docs": n, "tokens": tokens, "dtype": dtype, "base": base})
            base += tokens
    manifest = {"end_id": end_id, "tokens": base, "shards": listed}
    out = Published(f"{folder}/index.json")
    out.write(json.dumps(manifest).encode())
    out.close()
    return manifest


def read_manifest(folder: str) -> dict:
    store, path = open_store(f"{folder}/index.json")
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Documents of a written folder: id, start (tokens before it), n_tokens, ids_crc32, and the ids if `with_ids`.

    One task a shard, over memory-mapped files, or ranges of files in a store that can't be mapped. ids_crc32 is the unsigned crc32 of the ids as little-endian uint32.
    """
    shards = read_manifest(folder)["shards"]
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                s = shards[k]
                name = f"{folder}/shard-{s['shard']:05d}"
                tok, off, doc = mapped(f"{name}.tok", s["dtype"]), mapped(f"{name}.off", "<i8"), mapped(f"{name}.doc", "<i8")
                for a in range(0, len(doc), 4096):
                    b = min(a + 4096, len(doc))
                    at, names = np.asarray(off[a : b + 1]), np.asarray(doc[a:b])
                    block = tok[at[0] : at[-1]].astype("<u4")
                    ids = [block[x:y] for x, y in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                    out = {
                        id_col: pa.array(names, pa.int64(), mask=names == NULL_ID),
                        "start": pa.array(at[:-1] + s["base"]),
                        "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([x.astype("i8") for x in ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, schema)
