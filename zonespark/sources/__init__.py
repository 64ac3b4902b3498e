"""Reading image files, their tags and JSON exchange files; writing documents."""
