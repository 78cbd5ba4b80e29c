"""Plan building blocks: work tables, checked broadcasts."""
