"""Where rows come from and where they go: tables, folders of files, and tables written to the shared folder."""
