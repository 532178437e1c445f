"""python -m colophon.llm QUERY DATA OUT [--overwrite]: the same for the queries of the llm problems."""

from colophon.__main__ import run
from colophon.llm.queries import queries

if __name__ == "__main__":
    run(queries(), "colophon.llm")
