"""Operations on training corpora, each as Spark jobs over whole tables."""


def load() -> dict:
    """Queries by name, each as (function, SQL or None)."""
    from flowtide.llm.queries import QUERIES

    return QUERIES
