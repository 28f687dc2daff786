"""Plan-level building blocks: value counts, ordered counts, top-k, checked joins."""
