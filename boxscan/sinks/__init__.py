"""Final tables and the four text formats."""
