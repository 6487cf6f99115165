"""Reading and writing road data, and the grid fixture."""
