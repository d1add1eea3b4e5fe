"""Fair comparison of entities over large tables, as DataFrame-to-DataFrame functions."""
