"""Writers: the stored tables, report bundles and raw exports."""
