"""From text to checked command trees."""
