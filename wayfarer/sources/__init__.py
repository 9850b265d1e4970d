"""Table readers, writers and inspection."""
