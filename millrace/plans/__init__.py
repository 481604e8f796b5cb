"""Named queries over the shared test tables, each with an equivalent SQL statement where one exists."""
