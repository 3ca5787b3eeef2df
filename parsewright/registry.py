"""Named components, so that configurations can speak of them; models register at run time and load on the workers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry(dict[str, Any]):
    """Names to factories; an unknown name says which there are."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def add(self, name: str) -> Callable[[Any], Any]:
        def put(factory: Any) -> Any:
            self[name] = factory
            return factory

        return put

    def __missing__(self, name: str) -> Any:
        raise KeyError(f"unknown {self.kind} {name}; there are {', '.join(sorted(self)) or 'none'}")


PARSERS, CHUNKERS, EMBEDDERS, RETRIEVERS, GENERATORS = (Registry(k) for k in ("parser", "chunker", "embedder", "retriever", "generator"))


@PARSERS.add("TextParser")
def text_parser() -> Callable[[bytes], tuple[str, str, dict[str, str]]]:
    """Text files as they are; the format shows in how they begin."""

    def parse(data: bytes) -> tuple[str, str, dict[str, str]]:
        text = data.decode("utf-8", "replace")
        return text, "tei_xml" if text.lstrip().startswith("<") else "markdown", {"content_length": str(len(text))}

    return parse


def _defaults() -> None:
    from parsewright.operators import chunking, generation, retrieval

    CHUNKERS["LengthChunker"] = chunking.length_chunks
    CHUNKERS["TextStructureChunker"] = lambda df, text, size, overlap, id_col: chunking.structured_chunks(df, id_col, text, "TextStructureChunker", size, overlap)
    CHUNKERS["StructureChunker"] = lambda df, text, size, overlap, id_col: chunking.structured_chunks(df, id_col, text, "StructureChunker", size, overlap)
    EMBEDDERS["DefaultEmbedder"] = retrieval.embed_checksum
    RETRIEVERS["TopKRetriever"] = retrieval.take_top
    RETRIEVERS["TokenBudgetRetriever"] = retrieval.take_budget
    RETRIEVERS["CrossEncoderRetriever"] = retrieval.rerank
    RETRIEVERS["RCSRetriever"] = retrieval.rerank
    GENERATORS["stub"] = generation.stub_answer


_defaults()
