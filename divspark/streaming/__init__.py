"""Structured Streaming form of the collection stage: responses written as
files while generation runs are parsed and deduplicated as they arrive."""

from divspark.streaming.responses import parse_response_stream, write_parsed_stream

__all__ = ["parse_response_stream", "write_parsed_stream"]
