"""Column functions: words, stems, keyboard layouts."""
