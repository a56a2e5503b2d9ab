"""Where rows come from: landing folders, parsed pages, tables of a data folder."""
