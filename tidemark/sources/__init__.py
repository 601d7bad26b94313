"""Where rows come from: logs, catalogs, generators, fixtures."""
