"""Label validation rules."""
