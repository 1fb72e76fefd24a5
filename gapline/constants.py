"""Values that are part of the definition of the results: word lists, labels, limits and messages."""

from __future__ import annotations

# --- Fixed values: results are only right with exactly these ---------------------------------------------------

LABELS = [
    "O", "B-TECHNICALSKILL", "I-TECHNICALSKILL", "B-SOFTSKILL", "I-SOFTSKILL", "B-DESIGNATION", "I-DESIGNATION",
    "B-TOOLS", "I-TOOLS", "B-YEAROFEXPERIENCE", "I-YEAROFEXPERIENCE", "B-QUALIFICATION", "I-QUALIFICATION",
]
IGNORED_LABEL = -100

CATEGORIES = ["technicalskill", "softskill", "designation", "tools", "yearofexperience", "qualification"]
COMPARABLE = [c for c in CATEGORIES if c != "designation"]
SKILL_CATEGORIES = ["technicalskill", "softskill", "tools"]

TECHNICAL_SKILLS = [
    "Python", "Java", "JavaScript", "TypeScript", "C++", "C#", "Go", "Ruby", "Scala", "R", "MATLAB", "SQL", "NoSQL",
    "HTML", "CSS", "Flask", "Django", "FastAPI", "Spring Boot", "React", "Angular", "Vue.js", "Node.js", "Express.js",
    "MongoDB", "PostgreSQL", "MySQL", "Redis", "TensorFlow", "PyTorch", "Keras", "scikit-learn", "pandas", "NumPy",
    "XGBoost", "OpenCV", "machine learning", "deep learning", "natural language processing", "computer vision",
    "data analysis", "statistical modeling", "reinforcement learning", "time series analysis", "feature engineering",
    "REST APIs", "GraphQL", "microservices", "data structures", "algorithms", "object-oriented programming",
    "test-driven development", "Apache Spark", "Apache Kafka", "Apache Hadoop", "ETL pipelines", "CUDA", "Linux", "Bash",
]
TOOLS = [
    "Git", "GitHub", "GitLab", "Bitbucket", "Docker", "Kubernetes", "Jenkins", "Terraform", "Ansible", "Prometheus",
    "Grafana", "Tableau", "Power BI", "JIRA", "Confluence", "AWS", "GCP", "Azure", "Postman", "Figma", "Selenium",
    "Nginx", "RabbitMQ", "Datadog", "Airflow", "CircleCI", "Heroku", "Vercel", "Elasticsearch", "VS Code", "IntelliJ IDEA",
]
SOFT_SKILLS = [
    "communication", "leadership", "teamwork", "problem-solving", "critical thinking", "time management",
    "adaptability", "collaboration", "creativity", "mentorship", "presentation", "public speaking", "negotiation",
    "emotional intelligence", "attention to detail", "interpersonal", "organizational", "analytical thinking",
]
DESIGNATIONS = [
    "Software Engineer", "Senior Software Engineer", "Data Scientist", "Machine Learning Engineer", "Backend Developer",
    "Frontend Developer", "Full Stack Developer", "DevOps Engineer", "Data Engineer", "Data Analyst", "Cloud Architect",
    "Tech Lead", "Engineering Manager", "Product Manager", "Site Reliability Engineer", "QA Engineer",
    "Research Scientist", "AI Engineer", "Security Engineer", "Database Administrator", "Systems Administrator",
    "Principal Engineer", "Junior Developer",
]
DEGREES = [
    "Bachelor of Science", "Master of Science", "Bachelor of Arts", "Master of Arts", "Bachelor of Engineering",
    "Master of Engineering", "Bachelors", "Masters", "Bachelors degree", "Masters degree", "B.Tech", "M.Tech", "PhD",
    "Doctorate", "Associate degree",
]
FIELDS = [
    "Computer Science", "Data Science", "Information Technology", "Artificial Intelligence", "Machine Learning",
    "Software Engineering", "Electrical Engineering", "Mathematics", "Statistics", "Physics",
]
STANDALONE_DEGREES = ["MBA", "PhD", "Bachelors degree", "Masters degree", "Associate degree"]
DURATIONS = [
    "1 year", "2 years", "3 years", "4 years", "5 years", "6 years", "7 years", "8 years", "10 years", "12 years",
    "3+ years", "5+ years", "6+ years", "2+ years",
]
EXTRA_SKILLS = [
    "Rust", "Kotlin", "Swift", "PHP", "Perl", "Julia", "Svelte", "Next.js", "jQuery", "Tailwind CSS", "Redux", ".NET",
    "ASP.NET", "Laravel", "Ruby on Rails", "Hibernate", "gRPC", "OAuth", "Snowflake", "dbt", "Databricks", "Redshift",
    "BigQuery", "Cassandra", "DynamoDB", "Neo4j", "Hive", "ClickHouse", "PySpark", "relational database",
    "data modeling", "data warehousing", "data visualization", "data pipelines", "Helm", "Pulumi", "Argo CD", "Splunk",
    "Kibana", "OpenShift", "CloudFormation", "PowerShell", "CI/CD", "MLOps", "cloud computing", "distributed systems",
    "system design", "pytest", "JUnit", "Cypress", "Playwright", "Jest", "unit testing", "integration testing",
    "quality assurance", "code review", "Agile", "Scrum", "Kanban", "A/B testing", "artificial intelligence",
    "generative AI", "large language models", "prompt engineering", "LangChain", "Hugging Face", "MLflow", "ONNX",
    "Jupyter", "Matplotlib", "Seaborn", "Plotly", "SciPy",
]
ALIASES = {
    "ai": "artificial intelligence", "aws": "amazon web services", "b.e": "bachelor of engineering",
    "b.s": "bachelor of science", "b.sc": "bachelor of science", "b.tech": "bachelor of technology",
    "bsc": "bachelor of science", "btech": "bachelor of technology", "ci cd pipeline": "ci cd", "cicd": "ci cd",
    "dl": "deep learning", "gcp": "google cloud platform", "genai": "generative ai", "golang": "go",
    "hadoop": "apache hadoop", "js": "javascript", "kafka": "apache kafka", "k8": "kubernetes", "k8s": "kubernetes",
    "k8s cluster": "kubernetes", "m.s": "master of science", "m.sc": "master of science",
    "m.tech": "master of technology", "mba": "master of business administration", "ml": "machine learning",
    "msc": "master of science", "mtech": "master of technology",
    "natural language processing nlp": "natural language processing", "nlp": "natural language processing",
    "node": "node.js", "nodejs": "node.js", "oop": "object oriented programming", "ph.d": "doctor of philosophy",
    "phd": "doctor of philosophy", "postgres": "postgresql", "psql": "postgresql", "py torch": "pytorch",
    "qa": "quality assurance", "rdbms": "relational database", "react.js": "react", "reactjs": "react",
    "scikit": "scikit learn", "scikitlearn": "scikit learn", "sklearn": "scikit learn", "spark": "apache spark",
    "tensor flow": "tensorflow", "torch": "pytorch", "ts": "typescript", "vue": "vue.js",
}
#: The same with plurals folded in what they stand for.
ALIASES_FOLDED = ALIASES | {"aws": "amazon web service"}
GENERIC_TERMS = [
    "a", "an", "the", "and", "or", "we", "you", "us", "our", "your", "etc", "ability", "background", "bonus",
    "business", "candidate", "check", "client", "company", "customer", "degree", "domain", "education", "engineer",
    "environment", "excellent", "expectation", "experience", "expertise", "external", "field", "good", "great",
    "ideal", "industry", "internal", "is a plus", "job", "junior engineer", "knowledge", "member", "month", "must",
    "other", "platform", "plus", "a plus", "plus point", "position", "preferred", "process", "product",
    "proficiency", "project", "qualification", "related", "related field", "requirement", "required",
    "responsibility", "role", "senior engineer", "service", "should", "skill", "solid", "solution", "stakeholder",
    "strong", "summary", "system", "task", "team", "technology", "tool", "understanding", "various", "work",
    "working", "year",
]
UNFOLDED = [
    "aws", "kubernetes", "devops", "ops", "analysis", "analytics", "redis", "jenkins", "pandas", "windows", "rails",
    "status", "its", "cs",
]
DEGREE_RANKS = {
    "bachelor": 1, "bsc": 1, "b.sc": 1, "b.s": 1, "b.e": 1, "btech": 1, "b.tech": 1, "bca": 1, "bba": 1,
    "undergraduate": 1, "master": 2, "msc": 2, "m.sc": 2, "m.s": 2, "m.e": 2, "mtech": 2, "m.tech": 2, "mba": 2,
    "mca": 2, "postgraduate": 2, "doctor": 3, "doctorate": 3, "doctoral": 3, "phd": 3, "ph.d": 3,
}
NUMBER_WORDS = {
    "twenty": 20, "fifteen": 15, "twelve": 12, "eleven": 11, "ten": 10, "nine": 9, "eight": 8, "seven": 7, "six": 6,
    "five": 5, "four": 4, "three": 3, "two": 2, "one": 1,
}

#: Patterns of tokens and of durations, in lower case. White space is Unicode's.
TOKEN_PATTERN = r"[A-Za-z0-9]+(?:[+#.\-][A-Za-z0-9]+)*[+#]*|[^\sA-Za-z0-9]"
DATE_RANGE_PATTERN = (
    r"\b(?:19|20)\d{2}\b"
    r"|\b(?:january|february|march|april|june|july|august|september|october|"
    r"november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\b"
    r"|\b(?:present|current|till date|to date|ongoing|onwards)\b"
)
THOUSANDS_PATTERN = r"\d{1,3}(?:,\d{3})+(?![\d,])"
NUMBER_PATTERN = r"\d{1,3}(?:,\d{3})+(?![\d,])|\d+(?:[.,]\d{1,2}(?!\d))?|[.,]\d{1,2}(?!\d)"
ORDINAL_SUFFIX_PATTERN = r"\s*(?:st|nd|rd|th)\b"
SCHOOLING_PATTERN = (
    r"\b(?:grade|grades|class|classes|standard|semester|semesters|percentile|"
    r"percentage|cgpa|gpa|marks|matriculation)\b"
)
NEGATIVE_PATTERN = r"(?<!\d)-(?=[\d.,])"
MONTH_UNIT_PATTERN = r"(\d{1,3}(?:,\d{3})+(?![\d,])|\d+(?:[.,]\d{1,2}(?!\d))?|[.,]\d{1,2}(?!\d))\s*(?:months?|mos?)\b"

MOST_YEARS = 60
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e"
IN_WORD = "+#.-'&/"
MOST_WORD_CHARS, PROSE_RATIO, PROSE_WORDS = 20, 0.5, 40
SPECIAL_SUBWORDS, MOST_SUBWORDS, OVERLAP_WORDS, SEAM_RADIUS = 2, 512, 64, 16
SPLIT = (0.8, 0.1)
DATAGEN_SAMPLES, DATAGEN_SEED, MULTI_SHARE = 1200, 42, 40

#: Sentence templates: text, or (type, how many).
TEMPLATES = [
    ["Proficient in ", ("TECHNICALSKILL", 2), "."],
    ["Skilled in ", ("TECHNICALSKILL", 3), "."],
    ["Strong experience with ", ("TECHNICALSKILL", 2), "and ", ("TOOLS", 2), "."],
    ["Experienced ", ("DESIGNATION", 1), " with ", ("YEAROFEXPERIENCE", 1), " of experience."],
    ["Worked as a ", ("DESIGNATION", 1), " for ", ("YEAROFEXPERIENCE", 1), "."],
    ["We are hiring a ", ("DESIGNATION", 1), " proficient in ", ("TECHNICALSKILL", 2), "."],
    ["The ideal candidate has ", ("YEAROFEXPERIENCE", 1), " of experience in ", ("TECHNICALSKILL", 2), "."],
    ["Looking for a ", ("DESIGNATION", 1), " with strong ", ("SOFTSKILL", 2), "skills."],
    ["Excellent ", ("SOFTSKILL", 2), "skills."],
    ["Demonstrated ", ("SOFTSKILL", 2), "in fast-paced environments."],
    ["Holds a ", ("QUALIFICATION", 1), "."],
    ["Completed a ", ("QUALIFICATION", 1), " with strong ", ("SOFTSKILL", 1), " skills."],
    ["Requires a ", ("QUALIFICATION", 1), " and ", ("YEAROFEXPERIENCE", 1), " of relevant experience."],
    ["Used ", ("TOOLS", 2), "for deployment and CI/CD."],
    ["Experience with ", ("TOOLS", 3), "is required."],
    ["Deployed applications on ", ("TOOLS", 2), "."],
    ["Built scalable systems using ", ("TECHNICALSKILL", 2), "and ", ("TOOLS", 1), "."],
    [("DESIGNATION", 1), " skilled in ", ("TECHNICALSKILL", 2), "with ", ("YEAROFEXPERIENCE", 1), " of experience."],
    [("DESIGNATION", 1), " with a ", ("QUALIFICATION", 1), " and expertise in ", ("TECHNICALSKILL", 2), "."],
    ["Seeking a ", ("DESIGNATION", 1), " with ", ("YEAROFEXPERIENCE", 1), " of experience in ", ("TECHNICALSKILL", 2), "and ", ("TOOLS", 1), "."],
    ["Strong background in ", ("TECHNICALSKILL", 2), "and excellent ", ("SOFTSKILL", 1), " skills."],
    ["Proficient with ", ("TOOLS", 2), "and ", ("TECHNICALSKILL", 2), "."],
    ["Candidate should have ", ("YEAROFEXPERIENCE", 1), " of hands-on experience with ", ("TECHNICALSKILL", 2), "."],
    ["Responsible for building ", ("TECHNICALSKILL", 2), "using ", ("TOOLS", 2), "."],
    ["A ", ("QUALIFICATION", 1), " is preferred for this role."],
    ["Hands-on experience deploying ", ("TECHNICALSKILL", 1), " models with ", ("TOOLS", 2), "."],
]

#: Display orders: of the report and of the mail.
REPORT_LABELS = {
    "technicalskill": "Technical Skills", "tools": "Tools", "softskill": "Soft Skills", "designation": "Designation / Role",
    "yearofexperience": "Years of Experience", "qualification": "Qualification",
}
MAIL_LABELS = {
    "technicalskill": "Technical skills", "tools": "Tools & platforms", "softskill": "Soft skills",
    "qualification": "Qualifications", "yearofexperience": "Experience level", "designation": "Role alignment",
}

NOTE_UNVERIFIED = (
    "Could not check these job-description items against the resume: ",
    ". They match no skill, tool or qualification this tool knows, so they were left out of the gap list rather than "
    "reported as something the candidate lacks.",
)
NOTE_UNRANKABLE = (
    "Could not compare qualifications: no degree level this tool can rank appears in ",
    ", so the comparison was skipped rather than resolved either way.",
)
NOTE_NO_DEGREE = (
    "Could not compare qualifications: the job description asks for ",
    " but no degree was recognised in the resume, so no qualification gap was reported either way.",
)
NOTE_JD_YEARS = (
    "Could not compare years of experience: the job description states ",
    " rather than a duration this tool can read, and durations are never inferred from dates.",
)
NOTE_RESUME_YEARS = (
    "Could not compare years of experience: the resume states ",
    " rather than a duration, and this tool does not infer durations from dates.",
)
NOTE_NO_YEARS = (
    "Could not compare years of experience: no duration was extracted from the resume, so the job description's ",
    " was left unchecked.",
)
UNREADABLE = (
    "the ", " could not be read: it holds ", " ordinary words among ",
    " chunks of text, so most of it is not readable prose — markup, an encoding, symbols, or an alphabet this model "
    "was not trained on",
)
EMPTY_TEXT = ("the ", " was empty")
NO_REQUIREMENT = (
    "the job description names no skill, tool or qualification this tool recognises, so there is no requirement for a "
    "resume to be compared against"
)
NO_RESUME_TEXT = (
    "nothing in the resume was recognised as a skill, tool or qualification, and the resume text was not supplied, so "
    "a candidate who simply has none cannot be told apart from a document that never got read"
)
THIN_RESUME = (
    "nothing in the resume was recognised as a skill, tool or qualification, and it holds only ",
    " words — too little to read as a profile rather than a letterhead or a truncated paste",
)
HINT_UNREADABLE = (
    "That is what a scanned or badly-encoded PDF, a page of markup, or text in an alphabet the model was not trained "
    "on looks like. Please paste the text as plain readable English and try again."
)
HINT_THIN = (
    "The text itself was read; there is simply not enough of it to compare against. Please supply the full text and "
    "try again."
)
HINT_NO_REQUIREMENT = "Please paste the full posting, including the skills, tools and qualifications it asks for."
HINT_EMPTY = "Please paste the text and try again."
#: A fixed text: what it tells to call is the interface of the service whose messages these are.
HINT_NO_TEXT = (
    "Nothing is necessarily wrong with the resume itself. Pass resume_text to extraction_problem and run the analysis "
    "again."
)
COMPANY, RECRUITER, ROLE = "Acme Corp", "Sam", "Software Engineer"
MAIL = {
    "thanks": "Thank you for taking the time to apply for the {role} position at {company}. We truly appreciate your "
    "interest and the effort you put into your application.",
    "gaps": "After carefully reviewing your background against the requirements for this role, we identified a few "
    "areas that we'd encourage you to strengthen to be a closer match for similar positions:",
    "advice": "These are meant as constructive, specific suggestions rather than a reflection of your potential. "
    "Building depth in the areas above would make your profile notably more competitive.",
    "none": "Comparing your application against the requirements listed for this role, we did not identify any specific "
    "gaps to raise with you. That is not an assessment of your candidacy or a decision on your application — it means "
    "only that this comparison found no particular area to point you to against the requirements as listed.",
    "again": "We encourage you to apply again in the future, and we wish you every success in your job search.",
}
GAP_PROMPT = (
    "Write a concise, respectful rejection email for an applicant to the {role} role. Reference the skill gaps listed "
    "above as constructive, specific areas for growth. Be encouraging and professional. Company name is {company}; "
    "recruiter name is {recruiter}. Output only the email body, ready to send."
)
COMPARISON_PROMPT = (
    "You are {recruiter}, a recruiter at {company}, reviewing a candidate for the {role} role. Below are the skills, "
    "tools, qualifications and experience extracted from the JOB DESCRIPTION and from the CANDIDATE'S RESUME, grouped "
    "by category.\n\nJOB DESCRIPTION requires:\n",
    "\n\nCANDIDATE'S RESUME offers:\n",
    "\n\nCompare the two and determine where the candidate falls short of the role's requirements — the skills, tools, "
    "qualifications or experience the job needs that the resume does not show. Then write a concise, warm, professional "
    "feedback email to the candidate that thanks them for applying, explains those specific gaps as constructive areas "
    "to grow, and stays encouraging and respectful. Sign off as {recruiter}, {company} Recruiting Team. Output only the "
    "email body, ready to send.",
)
REPORT = {
    "no_entities": "  (no entities extracted)",
    "gaps": "=== Skill Gaps (in JD, missing from Resume) ===",
    "none_unchecked": "  None found — but not every requirement could be checked; see the notes below.",
    "none": "  None — resume covers everything the JD asks for.",
    "notes": "=== Notes — comparisons this tool could NOT make ===",
    "notes_end": "  (operator diagnostics — these are not findings about the candidate and must not be sent to them.)",
}

# --- End of fixed values ---------------------------------------------------------------------------------------

QUALIFICATIONS = [f"{d} in {f}" for d in DEGREES for f in FIELDS] + STANDALONE_DEGREES
VOCABULARY = {
    "TECHNICALSKILL": TECHNICAL_SKILLS, "TOOLS": TOOLS, "SOFTSKILL": SOFT_SKILLS, "DESIGNATION": DESIGNATIONS,
    "YEAROFEXPERIENCE": DURATIONS, "QUALIFICATION": QUALIFICATIONS,
}

#: What a draft says whose settings have changed, around role, company, recruiter and writer.
SETTINGS_CHANGED = (
    "This draft was written with the earlier settings (role: ", ", company: ", ", recruiter: ", ", writer: ",
    "). Run the analysis again to apply the current ones.",
)
