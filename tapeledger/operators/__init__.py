"""DataFrame operators: reconciliation, layout, repair planning, tags, setlists, catalogues."""
